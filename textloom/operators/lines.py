"""Line operators: each text is a list of lines; results keep the key and the order of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line."""
    return df.select(key, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def dedupe_lines(df: DataFrame, key: str, text: str, *, keep: str = "first", trim: bool = True, case_sensitive: bool = False, ignore_empty: bool = True) -> DataFrame:
    """key, line_no, line: the lines that stay. Keeping the last puts its content at the first's place.

    Blank lines pass when they are ignored. A text is one row, so its lines are told apart there: sorted by
    their keys, equal ones stand together. Nothing is shuffled; rows of equal key are texts of their own.
    """

    def keyed(x: Column, i: Column) -> Column:
        k = T.trim(x) if trim else x
        k = k if case_sensitive else F.lower(k)
        own = F.when(k == "" if trim else T.is_blank(x), i).otherwise(-1) if ignore_empty else F.lit(-1)
        return F.struct(k.alias("k"), own.alias("own"), i.alias("i"))

    def kept(s: Column) -> Column:
        """(place, line that goes there) of each key: groups of the sorted keys begin where a key differs from the one before."""
        at = F.transform(s, lambda x, j: F.when((j == 0) | (x["k"] != F.get(s, j - 1)["k"]) | (x["own"] != F.get(s, j - 1)["own"]), j))
        begins = F.filter(at, lambda j: j.isNotNull())
        last = lambda b: F.transform(b, lambda j, n: F.struct(F.get(s, j)["i"].alias("line_no"), F.get(s, F.coalesce(F.get(b, n + 1), F.size(s)) - 1)["i"].alias("of")))
        first = lambda b: F.transform(b, lambda j: F.struct(F.get(s, j)["i"].alias("line_no"), F.get(s, j)["i"].alias("of")))
        return T.bound(begins, last if keep == "last" else first)

    rows = df.select(key, T.lines(F.col(text)).alias("_l"))
    rows = rows.select(key, "_l", F.sort_array(F.transform("_l", keyed)).alias("_s"))
    out = rows.select(key, "_l", F.explode(kept(F.col("_s"))).alias("_k"))
    return out.select(key, F.col("_k.line_no").alias("line_no"), F.get("_l", F.col("_k.of")).alias("line"))


def number_lines(c: Column, *, start: int = 1, step: int = 1, pad_to: int = 0, separator: str = ". ", skip_blank: bool = True) -> Column:
    """The text with numbered lines, within the row: blank lines get none when they are skipped."""
    flag = (lambda x: (~T.is_blank(x)).cast("int")) if skip_blank else (lambda x: F.lit(1))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def numbered(s: Column) -> Column:
        last = F.lit(start) + F.lit(step) * (s["n"] - 1)
        width = F.lit(pad_to) if pad_to else F.greatest(F.length(last.cast("string")), F.length(F.lit(start).cast("string")))

        def one(w: Column) -> Column:
            def line(x: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                before = F.get(s["starts"], block) + total(F.slice(s["flags"], block * BLOCK + 1, i % BLOCK))
                number = (F.lit(start) + F.lit(step) * before).cast("string")
                return F.when(F.get(s["flags"], i) == 1, F.concat(F.lpad(number, F.greatest(w, F.length(number)), F.lit("0")), F.lit(separator), x)).otherwise(x)

            return F.array_join(F.transform(s["lines"], line), "\n")

        return T.bound(width, one)

    def blocks(s: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["lines"]) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(s["flags"], b * BLOCK + 1, BLOCK)))
        begun = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))
        done = F.aggregate(sums, begun, lambda a, x: F.struct((a["n"] + x).alias("n"), F.array_append(a["starts"], a["n"]).alias("starts")))
        return T.bound(done, lambda d: F.struct(s["lines"].alias("lines"), s["flags"].alias("flags"), d["n"].alias("n"), d["starts"].alias("starts")))

    flagged = T.bound(T.lines(c), lambda x: F.struct(x.alias("lines"), F.transform(x, flag).alias("flags")))
    return T.bound(T.bound(flagged, blocks), numbered)


#: Lines whose numbers are counted together, so that the work stays in proportion to a text's lines.
BLOCK = 32
#: Fixed value: a number at a line's start and what may follow it.
NUMBERED = r"^\s*\d+\s*(?:[.):|\]]|\s-\s|\t| {2,})\s?"


def strip_line_numbers(c: Column) -> tuple[Column, Column]:
    """(text without leading numbers, lines that had one)."""
    all_lines = T.lines(c)
    stripped = F.array_join(F.transform(all_lines, lambda x: F.regexp_replace(x, NUMBERED, "")), "\n")
    return stripped, F.size(F.filter(all_lines, lambda x: x.rlike(NUMBERED)))


def sort_lines(df: DataFrame, key: str, text: str, mode: str = "alpha", *, case_sensitive: bool = False) -> DataFrame:
    """key, place, line: the non-blank lines in order; equal lines keep theirs.

    Case counts where it is asked for, and among lines of equal number or length.
    """
    rows = explode_lines(df, key, text).where(~T.is_blank(F.col("line")))
    natural, number = T.natural_key(F.col("line"), case_sensitive or not mode.startswith("alpha")), T.numeric_key(F.col("line"))
    order = {
        "alpha": [natural.asc()],
        "alpha-desc": [natural.desc()],
        "numeric": [number.asc_nulls_last(), natural.asc()],
        "numeric-desc": [number.desc_nulls_last(), natural.asc()],
        "length": [F.length("line").asc(), natural.asc()],
        "length-desc": [F.length("line").desc(), natural.asc()],
    }[mode]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order, "line_no"))).select(key, "place", "line")


def shuffle_lines(c: Column, seed: int | None = None) -> Column:
    """The lines in random order, each order as likely."""
    return F.array_join(F.shuffle(T.lines(c), seed), "\n")


def reverse_text(c: Column, mode: str) -> Column:
    pieces = lambda x: F.regexp_extract_all(x, F.lit(rf"{T.SPACE}+|[^\s\x{{A0}}\x{{FEFF}}\x{{2028}}\x{{2029}}\p{{Zs}}]+"), 0)
    glyphs = lambda x: F.array_join(F.reverse(F.regexp_extract_all(x, F.lit(r"\X"), 0)), "")
    if mode == "lines":
        return F.array_join(F.reverse(T.lines(c)), "\n")
    if mode == "words":
        return F.array_join(F.reverse(pieces(c)), "")
    if mode == "words-in-line":
        return F.array_join(F.transform(T.lines(c), lambda x: F.array_join(F.reverse(pieces(x)), "")), "\n")
    if mode == "characters":
        return glyphs(c)
    return F.array_join(F.transform(pieces(c), lambda p: F.when(p.rlike(r"^\S"), glyphs(p)).otherwise(p)), "")


def invisible_census(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, code, name, n, lines (first five) of the catalogued characters; lines end at LF."""
    dim = F.create_map(*(F.lit(x) for code, name in T.INVISIBLE.items() for x in (chr(code), name)))
    klass = "[" + "".join(f"\\x{{{code:X}}}" for code in T.INVISIBLE) + "]"
    rows = df.where(F.col(text).rlike(klass)).select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    chars = rows.select(key, (F.col("line_no") + 1).alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(klass), 0)).alias("ch"))
    counts = chars.groupBy(key, "ch", "line_no").agg(F.count("*").alias("n"))
    out = counts.groupBy(key, "ch").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_set("line_no")), 1, 5).alias("lines"))
    return out.select(key, F.upper(F.lpad(F.hex(F.ascii("ch").cast("long")), 4, "0")).alias("code"), dim[F.col("ch")].alias("name"), "n", "lines")
