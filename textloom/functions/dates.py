"""Dates in texts, ranges of them, and durations as labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, words for now, what joins two dates, and the years that can be meant.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT = ("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sept", "sep", "oct", "nov", "dec")
NOW_WORDS = ("present", "currently", "current", "now", "today", "ongoing", "to date", "date")
JOIN = r"(?i)^\s*(?:[–—‒−-]{1,2}|to|until|through|thru|till)\s*$"
FIRST_YEAR, YEARS_AHEAD, LONGEST_JOIN = 1950, 8, 12

_A, _Z = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_NAMES = "|".join(sorted((*MONTHS, *SHORT), key=len, reverse=True))
#: What a token may look like; of two that overlap the kind that is listed first holds the place.
KINDS = {
    "present": rf"(?i){_A}(?:{'|'.join(NOW_WORDS)}){_Z}",
    "month": rf"(?i){_A}(?:{_NAMES})\.?[\s\x{{A0}},/-]+\d{{4}}{_Z}",
    "iso": rf"{_A}\d{{4}}[/-](?:0[1-9]|1[0-2]){_Z}",
    "numeric": rf"{_A}(?:0?[1-9]|1[0-2])[/-]\d{{4}}{_Z}",
    "year": rf"{_A}(?:19\d\d|20\d\d){_Z}",
}
TOKEN = "array<struct<at:int,size:int,year:int,month:int,format:string,present:boolean>>"


def places(c: Column, pattern: str) -> Column:
    """array of (at, match): where a pattern, which never matches nothing, matches; places count from 0."""
    marked = F.regexp_replace(F.translate(c, "\x01\x02", "  "), pattern, "\x01$0\x02")
    pieces = F.split(marked, "[\x01\x02]", -1)  # a gap, a match, a gap, ...
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,match:string>>").alias("out"), F.lit(False).alias("hit"))

    def step(acc: Column, piece: Column) -> Column:
        here = F.array(F.struct(acc["at"].alias("at"), piece.alias("match")))
        out = F.when(acc["hit"], F.concat(acc["out"], here)).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(piece)).alias("at"), out.alias("out"), (~acc["hit"]).alias("hit"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def date_tokens(c: Column, now: int) -> Column:
    """The dates of a text, by place: month and year, ISO month, month/year, year, or a word for now.

    now is year * 12 + month - 1. Years before 1950 or more than eight ahead are none. The kinds claim
    their places one after another; what overlaps a claimed place is no token.
    """
    year_now = now // 12

    def tokens(kind: str) -> Column:
        def one(p: Column) -> Column:
            text = p["match"]
            name = F.lower(F.regexp_extract(text, "^([A-Za-z]*)", 1))
            year = F.regexp_extract(text, r"((?<![0-9])[0-9]{4}(?![0-9]))", 1).try_cast("int")
            of_name = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(name, 1, 3)).cast("int")
            month, form = {
                "present": (F.lit(now % 12 + 1), F.lit("present")),
                "month": (of_name, F.when(F.length(name) <= 4, "Mon YYYY").otherwise("Month YYYY")),
                "iso": (F.regexp_extract(text, r"([0-9]{2})$", 1).try_cast("int"), F.lit("YYYY-MM")),
                "numeric": (F.regexp_extract(text, r"^([0-9]{1,2})", 1).try_cast("int"), F.lit("MM/YYYY")),
                "year": (F.lit(None).cast("int"), F.lit("YYYY")),
            }[kind]
            year = F.lit(year_now) if kind == "present" else year
            return F.struct(p["at"].alias("at"), F.length(text).alias("size"), year.alias("year"), month.alias("month"), form.alias("format"), F.lit(kind == "present").alias("present"))

        found = F.when(~c.rlike(KINDS[kind]), F.array().cast(TOKEN)).otherwise(F.transform(places(c, KINDS[kind]), one).cast(TOKEN))
        return F.filter(found, lambda t: t["year"].between(FIRST_YEAR, year_now + YEARS_AHEAD))

    apart = lambda a, b: (a["at"] + a["size"] <= b["at"]) | (b["at"] + b["size"] <= a["at"])
    claim = lambda held, t: F.when(F.forall(held, lambda h: apart(h, t)), F.array_append(held, t)).otherwise(held)
    every = F.concat(*(tokens(k) for k in KINDS))
    # few lines have what any kind needs: four digits, or a word for now
    return F.when(~c.rlike(rf"(?i){'|'.join(NOW_WORDS)}|[0-9]{{4}}"), F.array().cast(TOKEN)).otherwise(F.array_sort(F.aggregate(every, F.array().cast(TOKEN), claim)))


def date_range(c: Column, tokens: Column) -> Column:
    """raw, start_year, start_month, end_year, end_month, current, months, formats of the first range, else of the first date.

    A range is two tokens in a row with no more than a dash or "to" between them, the first not a word
    for now. A lone word for now is nothing; a lone date has no end and no months. A year alone begins in
    January and ends in December; both ends count.
    """
    at = lambda i: F.get(tokens, i)

    def joined(i: Column) -> Column:
        a, b = at(i), at(i + 1)
        gap = b["at"] - a["at"] - a["size"]
        return ~a["present"] & (gap <= LONGEST_JOIN) & F.substring(c, a["at"] + a["size"] + 1, gap).rlike(JOIN)

    pair = F.get(F.filter(F.when(F.size(tokens) > 1, F.sequence(F.lit(0), F.size(tokens) - 2)), joined), 0)

    def shaped(a: Column, b: Column | None, end: Column) -> Column:
        span = F.lit(None).cast("int") if b is None else F.greatest(F.lit(0), (b["year"] - a["year"]) * 12 + F.coalesce(b["month"], F.lit(12)) - F.coalesce(a["month"], F.lit(1)) + 1)
        formats = F.array(a["format"]) if b is None else F.array(a["format"], b["format"])
        none = F.lit(None).cast("int")
        return F.struct(
            F.substring(c, a["at"] + 1, end - a["at"]).alias("raw"),
            a["year"].alias("start_year"),
            a["month"].alias("start_month"),
            (none if b is None else b["year"]).alias("end_year"),
            (none if b is None else b["month"]).alias("end_month"),
            (F.lit(False) if b is None else b["present"]).alias("current"),
            span.alias("months"),
            F.array_distinct(F.filter(formats, lambda f: f != "present")).alias("formats"),
        )

    a, b, only = at(pair), at(pair + 1), at(F.lit(0))
    return F.when(pair.isNotNull(), shaped(a, b, b["at"] + b["size"])).when((F.size(tokens) > 0) & ~only["present"], shaped(only, None, only["at"] + only["size"]))


def month_index(year: Column, month: Column, end: bool = False) -> Column:
    """year * 12 + month - 1; a bare year is its January, as an end its December."""
    return year * 12 + F.coalesce(month, F.lit(12 if end else 1)) - 1


def range_months(start: Column, end: Column) -> Column:
    """Months of a range, both ends included."""
    return F.greatest(F.lit(0), end - start + 1)


def duration_label(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" sec"))).otherwise(F.concat(F.floor(seconds / 60 + 0.5).cast("string"), F.lit(" min")))


def stale(month: Column, now: str, after: int = 6) -> Column:
    """Whether an ISO month lies before the first day of the month that was after months ago."""
    return F.try_to_date(F.concat(month, F.lit("-01"))) < F.add_months(F.trunc(F.lit(now).cast("date"), "MM"), -after)
