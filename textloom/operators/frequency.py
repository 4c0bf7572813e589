"""Counts of characters, words and n-grams over all texts, and per-text statistics of letters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Letters of English texts, per cent.
ENGLISH = {"e": 12.02, "t": 9.10, "a": 8.12, "o": 7.68, "i": 7.31, "n": 6.95, "s": 6.28, "r": 6.02, "h": 5.92, "d": 4.32, "l": 3.98, "u": 2.88, "c": 2.71, "m": 2.61, "f": 2.30, "y": 2.11, "w": 2.09, "g": 2.03, "p": 1.82, "b": 1.49, "v": 1.11, "k": 0.69, "x": 0.17, "q": 0.11, "j": 0.10, "z": 0.07}


def _share(counts: DataFrame) -> DataFrame:
    """n and pct of each item: one row of totals is broadcast to the counts, which are few."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", T.half_up(F.col("n") * 100.0 / F.col("total"), 2)).drop("total")


def character_frequency(df: DataFrame, text: str, *, fold: bool = True, letters_only: bool = False) -> DataFrame:
    """char, n, pct, deviation (of letters, from English)."""
    c = F.lower(text) if fold else F.col(text)
    chars = df.select(F.explode(F.split(c, "", -1)).alias("char")).where("char <> ''")
    if letters_only:
        chars = chars.where(F.col("char").rlike(r"^\p{L}"))
    counts = _share(chars.groupBy("char").agg(F.count("*").alias("n")))
    usual = df.sparkSession.createDataFrame(list(ENGLISH.items()), "char string, usual double")
    return counts.join(F.broadcast(usual), "char", "left").withColumn("deviation", T.half_up(F.col("pct") - F.col("usual"), 2)).drop("usual")


def ngram_frequency(df: DataFrame, text: str, n: int = 1, *, stop_words: bool = False, min_length: int = 1) -> DataFrame:
    """gram, n, pct; n-grams are built from the words that the filters leave, within the row."""
    words = T.words(F.lower(text))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(T.STOP_WORDS))
    if min_length > 1:
        words = F.filter(words, lambda w: F.length(w) >= min_length)
    if n > 1:
        at = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        words = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, at(w)).otherwise(F.array().cast("array<string>"))), 0)
    grams = df.select(F.explode(words).alias("gram"))
    return _share(grams.groupBy("gram").agg(F.count("*").alias("n")))


def index_of_coincidence(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_letters, ic, verdict: two aggregates on (key, letter), no wide rows."""
    letters = df.select(key, F.explode(F.split(F.regexp_replace(F.lower(text), "[^a-z]", ""), "", -1)).alias("_c")).where("_c <> ''")
    counts = letters.groupBy(key, "_c").agg(F.count("*").alias("_k"))
    sums = counts.groupBy(key).agg(F.sum("_k").alias("_n"), F.sum(F.col("_k") * (F.col("_k") - 1)).alias("_pairs"))
    n = F.col("_n").cast("double")
    ic = F.when(n < 2, 0.0).otherwise(T.half_up(F.col("_pairs") / (n * (n - 1)), 4))
    out = df.select(key).join(sums, key, "left").select(key, F.coalesce("_n", F.lit(0)).alias("n_letters"), F.coalesce(ic, F.lit(0.0)).alias("ic"))
    return out.withColumn("verdict", F.when(F.abs(F.col("ic") - 0.0667) <= F.abs(F.col("ic") - 0.0385), "language").otherwise("random"))


CLASSES = (("letters", r"\p{L}"), ("digits", r"\p{Nd}"), ("whitespace", T.SPACE), ("punctuation", r"\p{P}"), ("symbols", r"\p{S}"))


def character_classes(c: Column) -> dict[str, Column]:
    """Characters of each class, the first that fits; what fits none is other."""
    out, known = {}, F.lit(0)
    for name, pattern in CLASSES:
        out[name] = F.regexp_count(c, F.lit(pattern))
        known = known + out[name]
    return out | {"other": F.length(c) - known}


@lru_cache
def _chars(of: str) -> str:
    """A class of the characters that have a Unicode property."""
    import regex

    found = regex.findall(rf"\p{{{of}}}+", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    return "[" + "".join(rf"\x{{{ord(f[0]):X}}}-\x{{{ord(f[-1]):X}}}" for f in found) + "]"


#: What isn't ASCII, with the printable character before it. Elsewhere each ASCII character is seen alone, but for CRLF.
_WIDE = r"[\x20-\x7E]?[^\x00-\x7F]+"
_CUT = "\ue000"  # stands where they were


def grapheme_classes(c: Column) -> dict[str, Column]:
    """Characters as they are seen (accents and joined emoji are one) of each class: emoji first, then the first that fits.

    Only what isn't ASCII is cut into the characters that are seen; ASCII is counted by the lengths that are left
    without each class. A text with a character that joins the one after it is cut up whole.
    """
    patterns = {"emoji": _chars("Extended_Pictographic"), "letters": r"^\p{L}\p{M}*$", "digits": r"^\p{Nd}$", "whitespace": rf"^{T.SPACE}$", "punctuation": r"^\p{P}$", "symbols": r"^\p{S}$"}
    plain = ("letters", r"[A-Za-z]+"), ("digits", "[0-9]+"), ("whitespace", r"\s+"), ("punctuation", r"\p{P}+"), ("symbols", r"\p{S}+"), ("other", rf"[^{_CUT}]+")
    names = (*patterns, "other")

    def kind(g: Column) -> Column:
        out = F.lit("other")
        for name, p in reversed(patterns.items()):
            out = F.when(g.rlike(p), name).otherwise(out)
        return out

    def wide(parts: Column) -> Column:
        """Counts of the classes in pieces of text."""
        kinds = F.array_join(F.transform(F.flatten(F.transform(parts, lambda x: F.regexp_extract_all(x, F.lit(r"\X"), 0))), kind), "  ")
        return T.bound(F.concat(F.lit(" "), kinds, F.lit(" ")), lambda k: F.array(*(F.regexp_count(k, F.lit(f" {n} ")) for n in names)))

    def ascii_counts(rest: Column, left: tuple, got: dict[str, Column]) -> Column:
        if not left:
            return F.array(*(got.get(n, F.lit(0)) for n in names))
        (name, p), *more = left
        less = lambda x: ascii_counts(x, tuple(more), got | {name: got.get(name, F.lit(0)) + F.octet_length(rest) - F.octet_length(x)})
        return T.bound(F.regexp_replace(rest, p, ""), less)

    rest = F.regexp_replace(c, _WIDE, _CUT)
    without = lambda x: F.replace(x, F.lit("\r\n"), F.lit(""))
    narrow = T.bound(rest, lambda x: T.bound(without(x), lambda y: ascii_counts(y, plain, {"other": ((F.octet_length(x) - F.octet_length(y)) / 2).cast("int")})))
    sums = T.bound(F.zip_with(narrow, wide(F.regexp_extract_all(c, F.lit(_WIDE), 0)), lambda a, b: a + b), lambda s: s)
    counts = F.when(c.rlike(_chars("Grapheme_Cluster_Break=Prepend")), wide(F.array(c))).otherwise(sums)
    return {name: F.get(counts, F.lit(i)) for i, name in enumerate(names)}


def keywords(df: DataFrame, key: str, text: str, limit: int = 28, known: Sequence[str] = ()) -> DataFrame:
    """key, term, n, place: each text's most frequent terms, twice at least; of equal ones the first to appear.

    Known terms (a short list) weigh four. Those of several words count once if they stand anywhere in
    the text, come first among equal ones, and their words no longer count alone.
    """
    low = F.lower(text)
    phrases = [k for k in known if " " in k and len(k) <= 32]
    kind = "array<struct<term:string,n:int,at:int>>"
    said = F.array(*(F.struct(F.lit(k).alias("term"), F.lit(4).alias("n"), F.lit(i - len(phrases)).alias("at")) for i, k in enumerate(phrases))).cast(kind)
    rows = df.where(F.length(T.trim(F.col(text))) >= 40).select(key, low.alias("_low"))
    rows = rows.select(key, F.regexp_extract_all("_low", F.lit(r"[a-z][a-z0-9+#.]{1,24}"), 0).alias("_terms"), F.filter(said, lambda s: F.contains("_low", s["term"])).alias("_said"))
    rows = rows.withColumn("_claimed", F.flatten(F.transform("_said", lambda s: F.split(s["term"], " "))))
    weight = lambda t: F.when(t.isin(*known), 4).otherwise(1) if known else F.lit(1)
    single = F.transform("_terms", lambda t, i: F.struct(t.alias("term"), weight(t).alias("n"), i.alias("at")))
    single = F.filter(single, lambda s: ~s["term"].isin(T.STOP_WORDS) & (F.length(s["term"]) >= 3) & ~F.array_contains("_claimed", s["term"]))
    terms = rows.select(key, F.explode(F.concat("_said", single.cast(kind))).alias("t"))
    counts = terms.groupBy(key, "t.term").agg(F.sum("t.n").alias("n"), F.min("t.at").alias("at")).where("n >= 2")
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "at"))).where(F.col("place") <= limit).drop("at")
