"""CVs as rows: lines, headings, sections, roles, bullets and contact details.

A text becomes lines, and everything else is windows over them, by text and line number: a heading is a
flag, a section the last heading so far, a role a running count of the lines that begin one. A role's
header may be two lines: a date right under an undated first line belongs to it. The windows share one
shuffle, by text. Null and empty texts have no lines; a text without headings is one experience section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import SPACE, bound, trim
from .relations import merge_intervals

# Headings, verbs, phrases and patterns that decide what is read and scored.
HEADINGS = {
    "summary": ("professional summary", "career summary", "executive summary", "personal statement", "career objective", "professional profile", "personal profile", "career profile", "about me", "summary of qualifications", "profile summary", "objective", "summary", "profile", "overview", "introduction"),
    "experience": ("professional experience", "work experience", "employment history", "career history", "relevant experience", "industry experience", "clinical experience", "teaching experience", "research experience", "work history", "employment", "experience", "career", "positions held", "appointments"),
    "education": ("education and training", "academic background", "academic qualifications", "educational qualifications", "education & training", "qualifications", "education", "academics", "academic history", "training"),
    "skills": ("technical skills", "core competencies", "key skills", "areas of expertise", "skills and competencies", "professional skills", "competencies", "expertise", "skills summary", "core skills", "tools and technologies", "technologies", "proficiencies", "skills"),
    "projects": ("selected projects", "key projects", "personal projects", "academic projects", "portfolio", "projects"),
    "certifications": ("certifications and licenses", "licenses and certifications", "professional development", "courses and certifications", "certifications", "certificates", "licenses", "accreditations", "courses"),
    "awards": ("awards and honours", "awards and honors", "honours and awards", "achievements", "accomplishments", "awards", "honours", "honors", "recognition"),
    "publications": ("publications and presentations", "publications", "presentations", "conferences", "patents"),
    "volunteer": ("volunteer experience", "community involvement", "voluntary work", "volunteering", "extracurricular activities", "leadership and activities", "volunteer"),
    "languages": ("language skills", "languages"),
    "interests": ("interests and hobbies", "hobbies and interests", "interests", "hobbies", "activities"),
    "references": ("references available", "referees", "references"),
}
VERB_GROUPS = {
    "leadership": ("lead", "manage", "direct", "head", "supervise", "oversee", "chair", "mentor", "coach", "guide", "coordinate", "orchestrate", "spearhead", "champion", "drive", "found", "establish", "hire", "recruit", "onboard", "delegate", "mobilise", "mobilize",),
    "achievement": ("achieve", "deliver", "exceed", "surpass", "win", "secure", "earn", "attain", "complete", "close", "land", "capture", "outperform", "beat", "accomplish",),
    "improvement": ("improve", "increase", "reduce", "cut", "optimise", "optimize", "streamline", "accelerate", "boost", "grow", "scale", "enhance", "strengthen", "raise", "lower", "minimise", "minimize", "maximise", "maximize", "eliminate", "consolidate", "standardise", "standardize", "simplify", "refine", "upgrade", "modernise", "modernize", "transform", "turn", "revamp", "overhaul", "restructure",),
    "creation": ("build", "create", "design", "develop", "launch", "ship", "implement", "introduce", "architect", "engineer", "produce", "author", "compose", "construct", "prototype", "pioneer", "initiate", "originate", "formulate", "draft", "write", "publish", "code", "program", "deploy", "configure", "integrate", "automate", "migrate", "rebuild",),
    "analysis": ("analyse", "analyze", "evaluate", "assess", "audit", "investigate", "research", "diagnose", "measure", "model", "forecast", "benchmark", "quantify", "validate", "test", "monitor", "track", "identify", "determine", "examine", "review", "interpret",),
    "communication": ("present", "negotiate", "persuade", "advise", "consult", "brief", "communicate", "collaborate", "partner", "liaise", "facilitate", "moderate", "train", "educate", "instruct", "counsel", "advocate", "represent", "pitch", "influence", "align",),
    "operations": ("execute", "run", "operate", "administer", "maintain", "support", "resolve", "troubleshoot", "process", "schedule", "plan", "organise", "organize", "allocate", "budget", "procure", "source", "ensure", "enforce", "comply", "document", "report", "serve", "treat", "care", "teach", "sell", "market",),
}
IRREGULAR = {"led": "lead", "built": "build", "ran": "run", "won": "win", "wrote": "write", "drove": "drive", "grew": "grow", "held": "hold", "made": "make", "met": "meet", "sold": "sell", "spoke": "speak", "taught": "teach", "took": "take", "brought": "bring", "bought": "buy", "chose": "choose", "cut": "cut", "dealt": "deal", "found": "find", "got": "get", "gave": "give", "kept": "keep", "left": "leave", "lost": "lose", "paid": "pay", "put": "put", "rose": "rise", "set": "set", "shot": "shoot", "sought": "seek", "spent": "spend", "stood": "stand", "struck": "strike", "taken": "take", "thought": "think", "understood": "understand", "oversaw": "oversee", "undertook": "undertake", "rebuilt": "rebuild", "shipped": "ship", "began": "begin"}
WEAK = ("responsible for", "duties included", "duties involved", "tasked with", "in charge of", "worked on", "worked with", "worked as", "helped with", "helped to", "assisted with", "assisted in", "involved in", "participated in", "took part in", "part of a team", "was part of", "contributed to", "supported the", "my role was", "my job was", "accountable for", "entrusted with", "handled", "dealt with", "looked after", "responsibilities include", "responsibilities included", "key responsibilities", "day to day", "day-to-day running")
CLICHES = ("team player", "hard worker", "hard working", "hardworking", "detail oriented", "detail-oriented", "results driven", "results-driven", "results oriented", "self motivated", "self-motivated", "self starter", "self-starter", "go getter", "go-getter", "think outside the box", "thinking outside the box", "outside the box", "proven track record", "track record of success", "excellent communication skills", "strong communication skills", "good communication skills", "excellent interpersonal", "strong work ethic", "works well under pressure", "work well under pressure", "fast learner", "quick learner", "passionate about", "dynamic professional", "highly motivated", "goal oriented", "goal-oriented", "people person", "synergy", "synergies", "value add", "value-add", "best of breed", "win win", "wearing many hats", "wear many hats", "ninja", "rockstar", "rock star", "guru", "thought leader", "seasoned professional", "multitasker", "multi-tasker")
HEDGES = ("various", "several", "numerous", "multiple", "many", "some", "a number of", "significantly", "substantially", "greatly", "successfully", "effectively", "efficiently", "consistently", "actively", "closely", "heavily", "extensively", "basically", "essentially", "literally", "really", "very", "quite", "fairly")
FIRST_PERSON = ("i ", "i,", "i'", "my ", "me ", "mine ", "myself", "we ", "our ", "us ")
GLYPHS = ("•", "·", "‣", "▪", "▫", "◦", "●", "○", "■", "□", "–", "—", "-", "*", ">", "»", "❖", "✓", "✔", "★", "+")
NUMBERED = r"^\(?\d{1,2}[.)]\s+"
ORG_SEPARATOR = r"\s+[|·•–—]\s+|\s+[-–—]\s+|\s+at\s+|\s*,\s+"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]{2,}"
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d[\d\s.-]{7,14}\d"
LINKEDIN = r"(?i)(?:https?://)?(?:[a-z]{2,3}\.)?linkedin\.com/(?:in|pub)/[A-Za-z0-9_%-]+"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9_-]+"
WEBSITE = r"(?i)(?:https?://)?(?:www\.)?[A-Za-z0-9_-]+\.(?:com|net|org|io|dev|me|co|design|xyz|app|portfolio|site)(?:/[A-Za-z0-9_%./-]*)?"
LOCATION = r"\b([A-Z][a-zA-Z.'-]+(?:\s[A-Z][a-zA-Z.'-]+)*),\s*([A-Z][a-zA-Z.'-]+(?:\s[A-Z][a-zA-Z.'-]+)*)\b"
SENSITIVE = {
    "date of birth": r"(?i)\bdate of birth\b|\bd\.?o\.?b\.?\b|\bborn on\b",
    "age": r"(?i)\bage\s*[:–-]\s*\d{2}\b|\b\d{2}\s+years?\s+old\b",
    "marital status": r"(?i)\bmarital status\b|\bmarried\b|\bunmarried\b|\bsingle\b(?=\s*[,.\n])",
    "gender": r"(?i)\bgender\s*[:–-]|\bsex\s*[:–-]\s*(?:male|female)",
    "nationality or religion": r"(?i)\bnationality\s*[:–-]|\breligion\s*[:–-]|\bcaste\s*[:–-]",
    "father's or spouse's name": r"(?i)\bfather'?s? name\b|\bspouse'?s? name\b|\bmother'?s? name\b",
    "a full home address": r"(?i:\b(?:house|flat|apt|apartment)\s*(?:no\.?|#)\s*\d+)|\b\d{1,4}\s+[A-Z][a-z]+\s+(?:street|road|avenue|lane)\b.*\b\d{4,6}\b",
    "national ID or passport number": r"(?i)\b(?:nid|national id|passport)\s*(?:no\.?|number|#)?\s*[:–-]?\s*[A-Z0-9]{6,}|\bssn\b",
}
DEGREES = (
    r"(?i)\b(b\.?\s?(?:sc|a|s|eng|com|ba|tech|ed)|bachelor(?:'?s)?)\b",
    r"(?i)\b(m\.?\s?(?:sc|a|s|eng|ba|com|tech|ed|phil)|master(?:'?s)?|mba)\b",
    r"(?i)\b(ph\.?\s?d|doctorate|doctoral|d\.?phil)\b",
    r"(?i)\b(associate(?:'?s)? degree|diploma|hnd|hnc|foundation degree)\b",
    r"(?i)\b(high school|secondary school|a[- ]levels?|gcse|hsc|ssc|matriculation|intermediate)\b",
    r"(?i)\b(md|dds|dvm|jd|llb|llm|bds|mbbs|pharmd|bsn|msn)\b",
)
METRICS = {
    "percentage": r"(?i)\b\d{1,3}(?:\.\d+)?\s*(?:%|percent(?:age)?(?:\s+points?)?\b|pp\b)",
    "money": r"(?i)(?:[$£€¥₹৳]|\b(?:usd|eur|gbp|inr|bdt|aud|cad)\b)\s?\d[\d,.]*\s?(?:k|m|bn|b|million|billion|thousand|lakh|crore)?",
    "multiple": r"(?i)\b\d+(?:\.\d+)?\s?x\b",
    "scale": r"(?i)\b\d[\d,]*\+?\s+(?:[a-z][a-z-]*\s+){0,3}(?:users?|customers?|clients?|patients?|students?|employees?|staff|people|members?|accounts?|stores?|sites?|units?|orders?|tickets?|calls?|articles?|records?|transactions?|downloads?|installs?|subscribers?|visitors?|projects?|campaigns?|reports?|markets?|countries|branches|vendors?|suppliers?)\b",
    "team size": r"(?i)\bteam of\s+\d+|\b\d+[\s-]+(?:person|member|engineer|developer|analyst|nurse|volunteer)s?\b",
    "time saved": r"(?i)\b\d+(?:\.\d+)?\s*(?:hours?|hrs?|days?|weeks?|months?|minutes?|mins?|seconds?|secs?|ms)\b",
    "rank": r"(?i)\b(?:top|first|no\.?|#)\s?\d{1,3}(?:%|st|nd|rd|th)?\b",
    "volume": r"(?i)\b\d[\d,]*(?:\.\d+)?\s?(?:k|m|bn|million|billion|thousand|lakh|crore)\b",
}
MOST_METRICS = 8
#: Sections whose lines are roles.
ROLE_SECTIONS = ("experience", "projects", "volunteer")

VERBS = tuple(v for group in VERB_GROUPS.values() for v in group)
BULLET = rf"^\s*(?:[{''.join(GLYPHS).replace('-', '') + '-'}]|\(?\d{{1,2}}[.)]\s)\s*"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[^a-z& ]+", " "), " +", " "))


def heading_kind(line: Column) -> Column:
    """The section that a line names: it is one of the synonyms, or one and a space and little more."""

    def kind(bare: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, synonyms in reversed(HEADINGS.items()):
            out = F.when(bare.rlike(rf"^(?:{'|'.join(synonyms)})(?: .{{0,11}})?$"), name).otherwise(out)
        return F.when(F.length(bare).between(1, 45), out)

    return bound(normalised(line), kind)


def is_bullet(line: Column) -> Column:
    return F.substring(line, 1, 1).isin(*GLYPHS) | line.rlike(NUMBERED)


def stripped(line: Column) -> Column:
    """A trimmed line without its bullet."""
    return F.when(F.substring(line, 1, 1).isin(*GLYPHS), trim(F.substring(line, F.lit(2), F.length(line)))).otherwise(trim(F.regexp_replace(line, NUMBERED, "")))


def _count_words(c: Column) -> Column:
    return F.size(F.split(c, rf"{SPACE}+"))


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line (trimmed, not empty), heading, section, section_no, last, glyphs.

    heading: the section that begins here. Of a kind that is named again only the first counts, and a
    text's last line is none. section_no is 0 above the first; glyphs: whether the text has bulleted lines.
    """
    rows = df.select(key, F.posexplode(F.split(text, "\r?\n", -1)).alias("line_no", "line")).select(key, "line_no", trim(F.col("line")).alias("line")).where("line <> ''")
    of_text, so_far = Window.partitionBy(key), Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumns({"kind": heading_kind(F.col("line")), "bullet": is_bullet(F.col("line"))})
    rows = rows.withColumns({"last": F.lead("line_no").over(so_far).isNull(), "glyphs": F.max("bullet").over(of_text)})
    rows = rows.withColumn("kind", F.when(~F.col("last"), F.col("kind")))
    nth = F.row_number().over(Window.partitionBy(key, "kind").orderBy("line_no"))
    rows = rows.withColumn("heading", F.when(nth == 1, F.col("kind")))
    found = {"section": F.last("heading", ignorenulls=True).over(so_far), "section_no": F.count("heading").over(so_far)}
    return rows.withColumns(found).select(key, "line_no", "line", "heading", "section", "section_no", "last", "bullet", "glyphs")


def base_verb(word: Column) -> Column:
    """The action verb of which a lower-case word is a form, or null: its stems are tried, the longest first."""
    regular = F.array(word, *(F.regexp_replace(word, p, to) for p, to in ((r"(.)\1(?:ed|ing)$", "$1"), (r"(?:ed|ing|es)$", "e"), (r"i(?:ed|es)$", "y"), (r"(?:ed|ing|es|s)$", ""))))
    irregular = F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv))[word]
    stems = F.when(irregular.isNotNull(), F.array(irregular)).otherwise(regular)
    return F.get(F.filter(stems, lambda w: w.isin(*VERBS)), 0)


def tense(word: Column) -> Column:
    """past, present, gerund or unknown, by the word's letters alone."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    return (
        F.when(w.isin(*IRREGULAR), "past")
        .when(w.endswith("ing"), "gerund")
        .when(w.endswith("ed"), "past")
        .when(w.isin(*VERBS) | (w.endswith("s") & F.regexp_replace(w, "s$", "").isin(*VERBS)), "present")
        .otherwise("unknown")
    )


def verb_group(verb: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, verbs in reversed(VERB_GROUPS.items()):
        out = F.when(verb.isin(*verbs), name).otherwise(out)
    return out


def metrics(c: Column) -> Column:
    """Measured results: kind by kind, the first eight."""
    found = F.concat(*(F.regexp_extract_all(c, F.lit(p), 0) for p in METRICS.values()))
    found = F.when(~c.rlike("[0-9]"), F.array().cast("array<string>")).otherwise(found)  # every kind has a digit
    return F.slice(F.transform(found, lambda m: trim(m)), 1, MOST_METRICS)


def role_lines(rows: DataFrame, key: str, now: int) -> DataFrame:
    """The lines of role sections with role_no (0, 1, ... in the text), source, part (header or body) and dates.

    A short line with a date range and no bullet begins a role; so does a section's first line. A range on
    a section's second line, under a first line without one, belongs to that role's header.
    """
    of_text, section = Window.partitionBy(key), Window.partitionBy(key, "section_no").orderBy("line_no")
    own = rows.withColumn("whole", F.max("section_no").over(of_text) == 0)
    own = own.where(F.col("whole") | (F.col("section").isin(*ROLE_SECTIONS) & F.col("heading").isNull()))
    own = own.withColumn("tokens", F.when(~F.col("bullet") & (F.length("line") < 120), dates.date_tokens(F.col("line"), now)))
    own = own.withColumn("dates", dates.date_range(F.col("line"), F.col("tokens"))).drop("tokens")
    own = own.withColumn("dates", F.when(F.col("dates.months").isNotNull(), F.col("dates")))
    dated = F.col("dates").isNotNull()
    own = own.withColumns({"at": F.row_number().over(section), "first_dated": F.first(dated).over(section)})
    joins = (F.col("at") == 2) & dated & ~F.col("first_dated")
    begins = (F.col("at") == 1) | (dated & ~joins)
    own = own.withColumns({"begins": begins, "part": F.when(begins | joins, "header").otherwise("body")})
    own = own.withColumn("role_no", F.sum(F.col("begins").cast("int")).over(Window.partitionBy(key).orderBy("line_no")) - 1)
    source = F.when(F.col("whole"), "experience").otherwise(F.col("section"))
    return own.select(key, "role_no", source.alias("source"), "line_no", "part", "line", "dates", "bullet", "glyphs")


def marked_lines(own: DataFrame, key: str) -> DataFrame:
    """own (of role_lines) with what each line says. Body lines of three words or more are bullets or prose.

    Where a text has bulleted lines only those are bullets; where it has none every such line is one.
    """
    text = F.when(F.col("bullet"), stripped(F.col("line"))).otherwise(F.col("line"))
    own = own.withColumns({"text": text}).withColumn("n_words", _count_words(F.col("text")))
    own = own.withColumns({"counts": (F.col("part") == "body") & (F.col("n_words") >= 3), "is_bullet": F.col("bullet") | ~F.col("glyphs")})
    own = own.withColumn("is_bullet", F.col("is_bullet") & F.col("counts"))
    return said(own.drop("bullet", "glyphs").withColumnRenamed("text", "bullet"))


def said(b: DataFrame) -> DataFrame:
    """b with what its column bullet says: verb, its group and tense, metrics, and the phrases that cost points."""
    low = F.concat(F.lit(" "), F.lower("bullet"), F.lit(" "))
    first = F.regexp_replace(F.lower(F.get(F.split("bullet", rf"{SPACE}+"), 0)), "[^a-z]", "")

    def some(words, before: str, after: str) -> Column:
        """The words that stand in the text with these blanks around them; what is looked for is a constant."""
        found = F.filter(F.array(*(F.lit(f"{before}{w}{after}") for w in words)), lambda w: F.contains(F.col("_low"), w))
        return F.transform(found, lambda w: F.substring(w, F.lit(len(before) + 1), F.length(w) - len(before) - len(after))) if before or after else found

    b = b.withColumns({"_low": low, "_first": first})
    b = b.withColumns({"verb": base_verb(F.col("_first")), "tense": tense(F.col("_first")), "metrics": metrics(F.col("bullet"))})
    return b.withColumns(
        {
            "verb_group": verb_group(F.col("verb")),
            "weak_opener": F.get(some(sorted(WEAK, key=len, reverse=True), " ", ""), 0),
            "cliches": some(CLICHES, "", ""),
            "hedges": some(HEDGES, " ", " "),
            "first_person": (F.size(some(FIRST_PERSON, " ", "")) > 0) | F.col("bullet").rlike(r"(?i)^i(?![A-Za-z0-9_])"),
            "stopped": F.col("bullet").rlike("[.;]$"),
        }
    ).drop("_low", "_first")


def once(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as generated ones: a filter on plain ones would be computed from the line again, with all that it names."""
    return df.select(F.inline(F.array(F.struct(*names))))


def held(df: DataFrame, key: str, times: int) -> DataFrame:
    """A text's rows as one row, dealt by key: what made them runs once, for all that reads the shuffle.

    The number of partitions is fixed, or they would be merged by their bytes: times that of tables that are spread.
    It must not be the number in which df lies by the key already, or nothing is shuffled and each reader makes df again.
    """
    spark = df.sparkSession
    n = times * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    one = df.groupBy(key).agg(F.collect_list(F.struct(*(c for c in df.columns if c != key))).alias("_rows"))
    return one.repartition(n, key)


def rows(held: DataFrame, key: str) -> DataFrame:
    return held.select(key, F.inline("_rows"))


def bullets(rows: DataFrame, key: str) -> DataFrame:
    """key, line_no, bullet and what it says, of all bulleted lines, in whatever section."""
    return said(rows.where("bullet").select(key, "line_no", stripped(F.col("line")).alias("bullet")).withColumn("n_words", _count_words(F.col("bullet"))))


def roles(marked: DataFrame, key: str) -> DataFrame:
    """One row a role, from marked lines: source, header, title, organisation, dates, bullets (in order), prose words, bullets by tense."""
    is_bullet, is_prose = F.col("is_bullet"), F.col("counts") & ~F.col("is_bullet")
    out = marked.groupBy(key, "role_no").agg(
        F.first("source").alias("source"),
        F.array_sort(F.collect_list(F.when(F.col("part") == "header", F.struct("line_no", "line")))).alias("h"),
        F.max("dates").alias("dates"),
        F.array_sort(F.collect_list(F.when(is_bullet, F.struct("line_no", "bullet")))).alias("b"),
        F.coalesce(F.sum(F.when(is_prose, F.col("n_words"))), F.lit(0)).cast("int").alias("prose_words"),
        *(F.count_if(is_bullet & (F.col("tense") == t)).alias(f"n_{t}") for t in ("past", "present")),
    )
    out = out.withColumn("header", F.array_join(F.transform("h", lambda x: x["line"]), " "))
    raw = F.col("dates.raw")
    at = F.instr("header", raw)
    bare = F.when(at > 0, F.concat(F.substring("header", F.lit(1), at - 1), F.lit(" "), F.substring("header", at + F.length(raw), F.length("header")))).otherwise(F.col("header"))
    bare = F.regexp_replace(bare, "[|·•]", " | ")
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s{2,}", " ")), r"[,|–—-]\s*$", "")
    parts = F.filter(F.transform(F.split(bare, ORG_SEPARATOR), lambda p: trim(p)), lambda p: F.length(p) > 1)
    out = out.withColumn("parts", parts)
    organisation = F.when(F.size("parts") > 1, F.array_join(F.slice("parts", 2, F.size("parts")), ", "))
    return out.select(key, "role_no", "source", "header", F.get("parts", F.lit(0)).alias("title"), organisation.alias("organisation"), "dates", F.transform("b", lambda x: x["bullet"]).alias("bullets"), "prose_words", "n_past", "n_present")


def experience(roles: DataFrame, key: str) -> DataFrame:
    """key, months, n_spans, n_gaps of the roles' date ranges; overlapping months count once."""
    d = roles.where("dates is not null").select(key, "dates.*")
    spans = d.select(key, dates.month_index(F.col("start_year"), F.col("start_month")).alias("s"), dates.month_index(F.col("end_year"), F.col("end_month"), end=True).alias("e")).where("s <= e")
    return merge_intervals(spans, key, "s", "e")


def looks_like_name(c: Column) -> Column:
    """One to five words in title case or capitals, without digits, that are no heading."""
    word = r"(?:[A-Z][a-zA-Z.'-]*|[a-z]{1,3})"
    shaped = c.rlike(rf"^{word}(?:\s+{word}){{0,4}}$") | (c.rlike(r"^[A-Z][A-Z\s.'-]+$") & (_count_words(c) <= 5))
    return F.length(c).between(3, 48) & shaped & heading_kind(c).isNull()


def contact(rows: DataFrame, key: str) -> DataFrame:
    """key, name, headline, email, phone, location, linkedin, github, website, sensitive, degrees.

    Read above the first heading, or in the first twelve lines; sensitive fields and degrees anywhere. The
    headline is the first of the three lines under the name that is neither contact detail nor heading.
    """
    of_text = Window.partitionBy(key)
    nth = F.row_number().over(of_text.orderBy("line_no"))
    top = rows.withColumns({"nth": nth, "whole": F.max("section_no").over(of_text) == 0})
    top = top.withColumn("top", (F.col("nth") == 1) | F.when(F.col("whole"), F.col("nth") <= 12).otherwise(F.col("section_no") == 0))
    every = F.struct("line_no", "line")
    joined = lambda c: F.transform(F.array_sort(c), lambda x: x["line"])
    d = top.groupBy(key).agg(joined(F.collect_list(F.when(F.col("top"), every))).alias("head"), F.array_join(joined(F.collect_list(every)), "\n").alias("text"))
    d = d.withColumn("at", F.coalesce(F.array_position(F.transform("head", looks_like_name), True), F.lit(0)).cast("int"))
    detail = lambda c: c.rlike(EMAIL) | c.rlike(PHONE) | c.rlike("(?i)linkedin|github|https?:")
    under = F.filter(F.slice("head", F.col("at") + 1, 3), lambda c: F.length(c).between(3, 90) & ~detail(c) & heading_kind(c).isNull())
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    d = d.withColumn("joined", F.array_join("head", "\n"))
    phone = F.trim(F.regexp_extract(F.regexp_replace(F.regexp_replace("joined", EMAIL, " "), r"https?://\S+", " "), PHONE, 0))
    digits = F.length(F.regexp_replace(phone, r"\D", ""))
    site = found(F.regexp_replace("joined", EMAIL, " "), WEBSITE)
    degrees = F.array_distinct(F.array_compact(F.array(*(F.trim(found(F.col("text"), p)) for p in DEGREES))))
    return d.select(
        key,
        F.when(F.col("at") > 0, F.get("head", F.col("at") - 1)).alias("name"),
        F.get(under, F.lit(0)).alias("headline"),
        found("joined", EMAIL).alias("email"),
        F.when(digits.between(8, 15), phone).alias("phone"),
        found("joined", LOCATION).alias("location"),
        found("joined", LINKEDIN).alias("linkedin"),
        found("joined", GITHUB).alias("github"),
        F.when(~site.rlike("(?i)linkedin|github"), site).alias("website"),
        F.array_compact(F.array(*(F.when(F.col("text").rlike(p), label) for label, p in SENSITIVE.items()))).alias("sensitive"),
        degrees.alias("degrees"),
    )


def coaching(rows: DataFrame, key: str) -> DataFrame:
    """key, line_no, bullet, hints (two at most) of bullets of twelve characters or more."""
    b = bullets(rows, key).where(F.length("bullet") >= 12)
    weak, strong = F.col("weak_opener").isNotNull(), F.col("verb").isNotNull()
    hints = F.array_compact(F.array(F.when(weak, "open with what you did"), F.when(F.size("metrics") == 0, "say how much"), F.when(~strong & ~weak, "open with a verb"), F.when(F.col("n_words") > 34, "shorten it")))
    told = once(b.select(key, "line_no", "bullet", F.slice(hints, 1, 2).alias("hints")), key, "line_no", "bullet", "hints")
    return told.where("size(hints) > 0")
