"""Skills of CVs: those a skills section lists, those of a given table that a text names, and levels of seniority.

Texts become phrases of as many words as the longest skill has, and phrases are joined to the table of
skills by equality; no text is compared with every skill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resume import BULLET, lines

# How lists of skills are split, what is taken off their entries, and titles that tell a level.
SPLIT = r"[,;|•·‣▪▣●○/]|\s{3,}|\s+[-–—]\s+"
HEDGE = r"(?i)^(?:familiar with|exposure to|knowledge of|working knowledge of|basic understanding of|some experience with|proficient in|experienced? (?:in|with))\s+"
EXECUTIVE = r"\b(?:chief|cxo|ceo|cto|cfo|coo|vp|vice president|president|partner|managing director)\b"
LEADING = r"\b(?:head of|director|principal|staff engineer|senior manager)\b"
STARTING = r"\b(?:intern|internship|trainee|apprentice|graduate scheme|junior|assistant)\b"
NOT_PHRASE = r"[^a-z0-9+#./ -]"


def seniority(titles: Column, months: Column, *, dated: Column, education: Column, experience: Column) -> Column:
    """student, entry, mid, senior or executive, from all titles as one text, months of work, and whether
    there is a dated role, an education and an experience section."""
    low = F.lower(F.coalesce(titles, F.lit("")))
    return (
        F.when(low.rlike(EXECUTIVE), "executive")
        .when(low.rlike(LEADING), F.when(months >= 96, "executive").otherwise("senior"))
        .when(~dated & education & ~experience, "student")
        .when(low.rlike(STARTING) & (months < 30), "entry")
        .when(months >= 120, "senior")
        .when(months >= 36, "mid")
        .when((months > 0) | experience, "entry")
        .otherwise("student")
    )


def _phrases(df: DataFrame, tokens: Column, longest: int, width: int, cuts: bool) -> DataFrame:
    """df's columns without _low and _phrase: the runs of 1 to longest tokens; with cuts also those that end before a comma or full stop.

    A row a token with the tokens after it comes first, so that a phrase is made of a row's few columns. Nothing
    of more than width characters can match, so a last token is read no further than that.
    """
    kept = [c for c in df.columns if c != "_low"]
    names = [f"_w{n}" for n in range(longest)]
    kind = f"array<struct<{','.join(f'{n}:string' for n in names)}>>"
    after = F.arrays_zip(*(F.slice("_tokens", F.lit(n + 1), F.greatest(F.size("_tokens"), F.lit(0))) for n in range(longest))).cast(kind)
    rows = df.withColumn("_tokens", tokens).select(*kept, F.inline_outer(after))  # outer: computed once, not for a filter as well

    def ends(last: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(last), F.lit(1))), lambda p: F.substring(last, p, F.lit(1)).isin(",", "."))
        whole = F.array(last)
        return F.when(F.contains(last, F.lit(",")) | F.contains(last, F.lit(".")), F.concat(whole, F.transform(at, lambda p: F.substring(last, F.lit(1), p - 1)))).otherwise(whole)

    def run(n: int) -> Column:
        last = F.substring(names[n - 1], 1, width + 1)
        found = ends(last) if cuts else F.array(last)
        if n == 1:
            return found
        before = F.concat(*(x for w in names[: n - 1] for x in (F.col(w), F.lit(" "))))
        whole = F.array(F.concat(before, last))
        return F.when(F.size(found) > 1, F.transform(found, lambda x: F.concat(before, x))).otherwise(whole) if cuts else whole

    phrase = F.explode_outer(F.concat(*(run(n) for n in range(1, longest + 1)))).alias("_phrase")
    return rows.select(*kept, phrase).where(F.length("_phrase") <= width)


#: Skills of at most so many rows are told to all tasks; phrases meet more by a shuffle.
MOST_TOLD = 200_000


def _bounds(skills: DataFrame, extra: int = 0) -> tuple[int, int, bool]:
    """(words, characters) of the longest skill, and whether they are few."""
    got = skills.agg(F.max(F.size(F.split("skill", " ", -1))), F.max(F.length("skill")), F.count("*")).first()
    return got[0] or 1, (got[1] or 0) + extra, got[2] <= MOST_TOLD


def known_skills(df: DataFrame, key: str, text: str, skills: DataFrame) -> DataFrame:
    """key, skill: the lower-case skills that stand in the text after a space (or its start) and before a space, comma, full stop or its end."""
    longest, width, few = _bounds(skills)
    rows = _phrases(df.select(key, F.lower(text).alias("_low")), F.split("_low", " ", -1), longest, width, True)
    wanted = skills.select(F.col("skill").alias("_phrase")).distinct()
    return rows.join(F.broadcast(wanted) if few else wanted, "_phrase").select(key, F.col("_phrase").alias("skill")).distinct()


def listed_skills(df: DataFrame, key: str, text: str, of_texts: DataFrame | None = None) -> DataFrame:
    """key, line_no, pos, skill: the entries of lines under a skills heading, without group labels, bullets, brackets and hedges.

    of_texts: the texts' lines, where they are at hand.
    """
    rows = (lines(df, key, text) if of_texts is None else of_texts).where("section = 'skills' and heading is null")
    body = F.regexp_replace("line", r"^[^:]*:", "")
    pieces = rows.select(key, "line_no", F.posexplode(F.split(body, SPLIT, -1)).alias("pos", "piece"))
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("piece", BULLET, "")), r"\([^)]*\)", ""), HEDGE, "")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    out = pieces.select(key, "line_no", "pos", bare.alias("skill"))
    out = out.where(F.length("skill").between(2, 40) & (F.size(F.split("skill", r"\s+")) <= 5))
    first = F.min(F.struct("line_no", "pos")).alias("at")
    return out.groupBy(key, "skill").agg(first).select(key, "at.line_no", "at.pos", "skill")


def cv_skills(df: DataFrame, key: str, text: str, skills: DataFrame, limit: int = 120) -> DataFrame:
    """key, place, skill: the listed skills in their order, then known ones that are not among them, by name; limit for each text."""
    listed = listed_skills(df, key, text)
    named = known_skills(df, key, text, skills)
    new = named.join(listed.select(key, F.lower("skill").alias("skill")).distinct(), [key, "skill"], "left_anti")
    none = F.lit(None).cast("int")
    every = listed.select(key, "line_no", "pos", "skill").union(new.select(key, none, none, "skill"))
    w = Window.partitionBy(key).orderBy(F.col("line_no").asc_nulls_last(), "pos", "skill")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(key, "place", "skill")


def field_skills(df: DataFrame, key: str, text: str, field: str, skills: DataFrame) -> DataFrame:
    """key, field, n_wanted, present, missing: which skills of its field (skills: field, skill) a text names, plurals included.

    All but letters, digits and + # . / - counts as a space. A field without skills wants none. key names one row.
    """
    longest, width, few = _bounds(skills, 1)
    wanted = skills.groupBy(field).agg(F.array_sort(F.collect_set("skill")).alias("_wanted"))
    forms = skills.select(field, "skill", F.explode(F.array("skill", F.concat("skill", F.lit("s")))).alias("_phrase")).distinct()
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), NOT_PHRASE, " "), r"\s+", " ")
    rows = _phrases(df.select(key, field, bare.alias("_low")), F.split("_low", " ", -1), longest, width, False)
    found = rows.join(F.broadcast(forms) if few else forms, [field, "_phrase"]).groupBy(key).agg(F.array_sort(F.collect_set("skill")).alias("_present"))
    none = F.array().cast("array<string>")
    out = df.select(key, field).join(wanted, field, "left").join(found, key, "left")
    out = out.select(key, field, F.coalesce("_wanted", none).alias("_wanted"), F.coalesce("_present", none).alias("present"))
    return out.select(key, field, F.size("_wanted").alias("n_wanted"), "present", F.array_except("_wanted", "present").alias("missing"))
