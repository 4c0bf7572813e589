"""Regular expressions and replacement rules over texts: places and captures of matches, risky patterns, rule lists."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound

# Shapes of patterns that can take exponential time, and what is said of them.
RISKS = (
    (r"\([^()]*[+*]\s*\)\s*[+*{]", "a quantifier applied to a group that already repeats — for example (a+)+"),
    (r"\([^()]*\|[^()]*\)\s*[+*]", "an alternation inside a repeated group, which can backtrack exponentially"),
    (r"(\.\*){3,}|(\.\+){3,}", "several unbounded wildcards in sequence"),
)


def pattern_risk(pattern: Column) -> Column:
    """Why a pattern may take exponential time, or null; an alternation only counts beside a repetition outside groups."""
    outside = F.regexp_replace(pattern, r"\([^()]*\)", "").rlike("[+*]")
    (nested, said_nested), (either, said_either), (wild, said_wild) = RISKS
    return F.when(pattern.rlike(nested), said_nested).when(pattern.rlike(either) & outside, said_either).when(pattern.rlike(wild), said_wild)


#: Characters that mark a match's start, the parts of it, and its end while places are counted; texts have none.
OPEN, PART, SHUT = "\ufdd0", "\ufdd1", "\ufdd2"
#: Matches whose places are added up together, so that the work stays in proportion to a text's matches.
BLOCK = 64
_PLACE = "array<struct<index:int,line:int,start:int,match:string,captures:array<string>>>"


def _counted(c: Column) -> Column:
    """Length, line ends and the place after the last line end (or -1) of a piece."""
    after = F.when(c.contains("\n"), F.length(c) - F.length(F.substring_index(c, "\n", -1))).otherwise(-1)
    return F.struct(F.length(c).alias("n"), (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).alias("ends"), after.alias("after"))


def _java(pattern: str, flags: str) -> str:
    """A browser's pattern for Java: a line also begins at the end of a text that ends a line, and $ alone is the text's very end."""
    out, in_class, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        if not in_class and c == "^" and "m" in flags:
            c = r"(?:^|\A|(?<=\n)\z)"
        elif not in_class and c == "$" and "m" not in flags:
            c = r"\z"
        out.append(c)
        at += 1
    java = "".join(f for f in ("i", "u", "m", "s") if f in flags and (f != "u" or "i" in flags))
    # no match begins within a character that Java holds as two
    return (f"(?{java})" if java else "") + r"(?![\x{DC00}-\x{DFFF}])(?:" + "".join(out) + ")"


def match_places(c: Column, pattern: str, groups: int = 0, flags: str = "g") -> Column:
    """array of (index, line, start of the line, match, captures) of a text's matches.

    The text is marked at its matches, which an empty match bears too, and cut at the marks. Pieces are
    added up in blocks, then the blocks. Matching goes on past an empty match by one character.
    """
    if set(flags) - set("gimsu"):
        raise ValueError(f"flags are g, i, m, s and u, not {flags}")
    pattern = _java(pattern, flags)
    plain = F.translate(c, OPEN + PART + SHUT, "   ")
    marked = F.regexp_replace(plain, pattern, OPEN + PART.join(f"${g}" for g in range(groups + 1)) + SHUT)

    def unit(pieces: Column):
        def one(i: Column) -> Column:
            parts = F.split(F.get(pieces, 2 * i + 1), PART, -1)
            return F.struct(_counted(F.get(pieces, 2 * i)).alias("gap"), F.get(parts, 0).alias("match"), _counted(F.get(parts, 0)).alias("hit"), F.slice(parts, 2, max(groups, 1)).alias("captures"))

        return one

    def add(acc: Column, u: Column) -> Column:
        gap, hit = u["gap"], u["hit"]
        index, line = acc["at"] + gap["n"], acc["line"] + gap["ends"]
        start = F.when(gap["after"] >= 0, acc["at"] + gap["after"]).otherwise(acc["start"])
        here = F.array(F.struct(index.alias("index"), line.alias("line"), start.alias("start"), u["match"].alias("match"), u["captures"].alias("captures")))
        return F.struct(
            (index + hit["n"]).alias("at"),
            (line + hit["ends"]).alias("line"),
            F.when(hit["after"] >= 0, index + hit["after"]).otherwise(start).alias("start"),
            F.concat(acc["out"], here.cast(_PLACE)).alias("out"),
        )

    def blocks(units: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(-1).alias("start"), F.array().cast(_PLACE).alias("out"))
        summed = F.transform(F.sequence(F.lit(0), F.floor((F.size(units) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(units, b * BLOCK + 1, BLOCK), begin, add))
        whole = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(0).alias("start"), F.array().cast(f"array<{_PLACE}>").alias("out"))

        def join(acc: Column, b: Column) -> Column:
            moved = F.transform(b["out"], lambda x: F.struct((acc["at"] + x["index"]).alias("index"), (acc["line"] + x["line"]).alias("line"), F.when(x["start"] >= 0, acc["at"] + x["start"]).otherwise(acc["start"]).alias("start"), x["match"].alias("match"), x["captures"].alias("captures")))
            start = F.when(b["start"] >= 0, acc["at"] + b["start"]).otherwise(acc["start"])
            return F.struct((acc["at"] + b["at"]).alias("at"), (acc["line"] + b["line"]).alias("line"), start.alias("start"), F.array_append(acc["out"], moved).alias("out"))

        return F.flatten(F.aggregate(summed, whole, join, lambda acc: acc["out"]))

    def units(pieces: Column) -> Column:
        n = F.floor((F.size(pieces) - 1) / 2).cast("int")
        n = n if "g" in flags else F.least(n, F.lit(1))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), unit(pieces))).otherwise(F.array())

    found = bound(F.split(marked, f"[{OPEN}{SHUT}]", -1), lambda x: bound(units(x), lambda u: F.when(F.size(u) > 0, blocks(u)).otherwise(F.array().cast(_PLACE))))
    return F.when(c.isNotNull(), found)


def find_all(df: DataFrame, key: str, text: str, pattern: str, groups: int = 0, flags: str = "g", limit: int | None = None) -> DataFrame:
    """key, n, index, line, column, match, captures of each match; places count from 0, lines, columns and n from 1.

    flags: g (all matches, else the first), i, m, s, u. limit: rows of a text at most. Captures that take no
    part are ''. An empty pattern finds nothing. Everything happens within the row.
    """
    if not pattern:
        return df.limit(0).select(key, *(F.lit(None).cast(k).alias(c) for c, k in (("n", "int"), ("index", "int"), ("line", "int"), ("column", "int"), ("match", "string"), ("captures", "array<string>"))))
    rows = df.select(key, F.posexplode(match_places(F.col(text), pattern, groups, flags)).alias("at", "m"))
    if limit is not None:
        rows = rows.where(F.col("at") < limit)
    captures = F.col("m.captures") if groups else F.array().cast("array<string>")
    return rows.select(key, (F.col("at") + 1).alias("n"), "m.index", (F.col("m.line") + 1).alias("line"), (F.col("m.index") - F.col("m.start") + 1).alias("column"), "m.match", captures.alias("captures"))


def match_stats(df: DataFrame, key: str, text: str, pattern: str, flags: str = "g", limit: int = 500) -> DataFrame:
    """key, total, listed (of the first limit), n_lines (that have a match), matched_chars, longest, has_empty; a text without matches has zeros."""
    found = match_places(F.col(text), pattern, 0, flags)
    rows = df.where(F.col(text).isNotNull()).select(key, found.alias("m"))
    sizes = F.transform("m", lambda x: F.length(x["match"]))
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    return rows.select(key, F.size("m").alias("total"), F.least(F.size("m"), F.lit(limit)).alias("listed"), F.size(F.array_distinct(F.transform("m", lambda x: x["line"]))).alias("n_lines"), total.alias("matched_chars"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("longest"), F.exists(sizes, lambda n: n == 0).alias("has_empty"))


@dataclass(frozen=True)
class Rule:
    find: str
    replace: str = ""


def parse_rules(source: str) -> list[Rule]:
    """Rules of a list, one a line: find => replace; # begins a comment, no arrow removes what is found."""
    found = [line.strip() for line in re.split(r"\r\n|\r|\n", source)]
    parts = [line.partition("=>") for line in found if line and not line.startswith("#")]
    return [Rule(a.strip(), b.strip()) for a, _, b in parts]


def _replacement(to: str) -> str:
    """A replacement with $$, $&, $1 and $<name>, as Java writes it."""

    def one(m: re.Match) -> str:
        x = m[0]
        if x == "\\":
            return "\\\\"
        return {"$$": r"\$", "$&": "$0", "$": r"\$"}.get(x) or (f"${{{x[2:-1]}}}" if x.startswith("$<") else x)

    return re.sub(r"\$\$|\$&|\$<\w+>|\$\d{1,2}|\$|\\", one, to)


def apply_rules(c: Column, rules: list[Rule], *, regex: bool = False, case_sensitive: bool = True, whole_word: bool = False, first_only: bool = False) -> Column:
    """A struct of output and matches (of each rule); each rule sees what the one before it made.

    Rules that find nothing by definition, of an empty search, have no matches.
    """

    def applied(rule: Rule):
        pattern = rule.find if regex else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", rule.find)
        pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{pattern})(?![\p{{L}}\p{{N}}])" if whole_word else pattern
        pattern = pattern if case_sensitive else f"(?iu){pattern}"
        to = _replacement(rule.replace)

        def one(s: Column) -> Column:
            text = s["output"]
            if not rule.find:
                n = F.lit(0)
            elif first_only:
                n = text.rlike(pattern).cast("int")
                head, hit = F.get(F.split(text, pattern, 2), 0), F.regexp_extract(text, pattern, 0)
                rest = F.substring(text, F.length(head) + F.length(hit) + 1, F.length(text))
                text = F.when(n == 1, F.concat(head, F.regexp_replace(hit, pattern, to), rest)).otherwise(text)
            else:
                n = F.regexp_count(text, F.lit(pattern))
                text = F.regexp_replace(text, pattern, to)
            return F.struct(text.alias("output"), F.array_append(s["matches"], n).alias("matches"))

        return one

    out = F.struct(c.alias("output"), F.array().cast("array<int>").alias("matches"))
    for rule in rules:
        out = bound(out, applied(rule))
    return out


def changed_lines(before: Column, after: Column, most: int = 20) -> Column:
    """Numbers, from 1, of the first lines that differ; the longer text's further lines do."""
    zipped = F.arrays_zip(F.split(before, "\n", -1).alias("a"), F.split(after, "\n", -1).alias("b"))
    marks = F.transform(zipped, lambda p, i: F.when(~p["a"].eqNullSafe(p["b"]), i + 1))
    return F.slice(F.filter(marks, lambda x: x.isNotNull()), 1, most)


def verified_rewrites(rewrites: DataFrame, texts: DataFrame, key: str, text: str, order: str, limit: int = 5) -> DataFrame:
    """The rewrites (key, order, before, after) whose before stands in their text, the first ones of each key.

    White space and case don't count; of a before of more than 40 characters the first 40 are enough.
    """
    strip = lambda c: F.regexp_replace(F.trim(c), r"^[-•·*\s]+", "")
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    fit = rewrites.where((F.length(F.trim("before")) > 8) & (F.length(F.trim("after")) > 8) & (F.trim("before") != F.trim("after")))
    pairs = fit.withColumns({"before": strip(F.col("before")), "after": strip(F.col("after"))}).join(texts.select(key, plain(F.col(text)).alias("_hay")), key)
    needle = plain(F.col("before"))
    kept = pairs.where(F.col("_hay").contains(needle) | ((F.length(needle) > 40) & F.col("_hay").contains(F.substring(needle, 1, 40)))).drop("_hay")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("place") <= limit)


def structured(c: Column, schema: str, needed: list[str]) -> Column:
    """The JSON of a reply, in a fence or bare, as a struct; null if it isn't JSON or lacks a needed field."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    value = F.from_json(F.trim(F.when(fenced != "", fenced).otherwise(c)), schema)
    whole = F.lit(True)
    for name in needed:
        whole = whole & value[name].isNotNull()
    return F.when(whole, value)
