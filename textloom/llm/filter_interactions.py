"""Filter interaction audit: what each filter removes in any order of the filters, from counts of what rows fail.

1. Each row gets a mask of the filters that it fails; the masks are counted by part, with the rows that
   have a gain (a good label, a toxic one) apart. From here on nothing grows with the rows: a part has at
   most 2^n masks, whatever share of the rows it holds.
2. A part's counts are its removal polynomial: a row that fails the filters m is removed with
   1 - prod over m of (1 - x_i), where x_i says how far filter i is applied. It is multilinear; its value
   at a corner of the cube is the number of rows that a set of filters removes. All that an order of
   filters reports follows from the corners along its way.
3. A filter's Shapley value is the integral of the polynomial's partial derivative along the cube's
   diagonal, in exact rationals. Times n! it is what the filter removes, summed over all orders.

Null texts are empty, a null part is the empty string. An empty table gives no row. Equal rows count
each; a copy is a row whose text a row with a smaller id holds, so rows of one id are no copies of each
other, a row with a null id is none and makes none. A label counts for all rows of its id; an id with
several labels has a gain if one of them has it. Very long texts are read whole. Columns that are not
named are ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

BLANK = r"[\x20\x09-\x0D]+"


def polynomial(counts: Mapping[int, int]) -> dict[int, int]:
    """Coefficients of the removal polynomial by the set of its variables, from the counts of the masks."""
    out: dict[int, int] = {}
    for mask, n in counts.items():
        s = mask
        while s:
            out[s] = out.get(s, 0) + (n if s.bit_count() % 2 else -n)
            s = (s - 1) & mask
    return out


def corner(coefficients: Mapping[int, int], chosen: int) -> int:
    """Its value where the chosen variables are 1 and the others 0."""
    return sum(c for s, c in coefficients.items() if s & chosen == s)


def shapley(coefficients: Mapping[int, int], i: int) -> Fraction:
    """The integral over t of its partial derivative by variable i, with all variables at t."""
    derivative: dict[int, int] = {}  # by the power of t
    for s, c in coefficients.items():
        if s >> i & 1:
            derivative[s.bit_count() - 1] = derivative.get(s.bit_count() - 1, 0) + c
    return sum((Fraction(c, power + 1) for power, c in derivative.items()), Fraction(0))


def report(names: Sequence[str], counts: Mapping[int, int], gains: Mapping[str, Mapping[int, int]]) -> list[dict]:
    """A row for each order of the filters and each of its steps."""
    n, all_of = len(names), (1 << len(names)) - 1
    total, by = sum(counts.values()), {g: polynomial(c) for g, c in gains.items()}
    p = polynomial(counts)
    at = {g: [corner(c, s) for s in range(all_of + 1)] for g, c in {"": p, **by}.items()}
    removed = at[""]
    value = [shapley(p, i) * factorial(n) for i in range(n)]
    rows = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            now = before | 1 << i
            gone = removed[now] - removed[before]
            rows.append(
                {
                    "filter_order": "".join(names[k] for k in order),
                    "step": step,
                    "kept": total - removed[now],
                    "removed": gone,
                    "redundant": removed[1 << i] - gone,
                    "unique_fails": removed[all_of] - removed[all_of ^ 1 << i],
                    **{g: at[g][now] - at[g][before] for g in gains},
                    "shapley": int(value[i]),
                }
            )
            before = now
    return rows


def mask_counts(rows: DataFrame, gains: Sequence[str]) -> DataFrame:
    """part, mask, n and a count for each gain (boolean columns)."""
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.count_if(F.col(g)).alias(g) for g in gains))


def interactions(counts: DataFrame, names: Sequence[str], gains: Sequence[str]) -> DataFrame:
    """The report of each part from its mask counts: bit i of a mask is names[i]."""

    def run(group: pa.Table) -> pa.Table:
        d = group.to_pydict()
        of = lambda c: dict(zip(d["mask"], d[c], strict=True))
        rows = report(names, of("n"), {g: of(g) for g in gains})
        return pa.Table.from_pylist([{"part": d["part"][0], **r} for r in rows], schema=kinds)

    longs = ["kept", "removed", "redundant", "unique_fails", *gains, "shapley"]
    kinds = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in longs)])
    return counts.groupBy("part").applyInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))


def text_failures(words: Column, text: Column) -> list[Column]:
    """Too few words, too few different ones, too many capitals, a character of tables and markup."""
    n = F.size(words)
    return [
        n < 200,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > F.lit(2) * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def mask_of(failures: Sequence[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0))


def failed_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good_lost and toxic_lost (booleans) of each row: the failures of its text, and whether it is a copy.

    Texts are read once and leave a digest of 256 bits; copies are told by it. What is joined are digests
    that occur more than once, and labels that say something; joins on either side of a hot digest split.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, BLANK), "").alias("words"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    rows = materialize(split.select("doc_id", "part", mask_of(text_failures(F.col("words"), F.col("text"))).alias("mask"), digest), "filter-masks")
    held = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where((F.col("n") > 1) & F.col("first").isNotNull())
    firsts = materialize(held.select("digest", "first"), "first-copies")
    known = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good_lost"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic_lost"))
    known = materialize(known.where("doc_id is not null and (good_lost or toxic_lost)"), "labels-that-say")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    out = rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask")).join(known, "doc_id", "left")
    return out.select("part", "mask", *(F.coalesce(g, F.lit(False)).alias(g) for g in ("good_lost", "toxic_lost")))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gains = ("good_lost", "toxic_lost")
    return interactions(mask_counts(failed_masks(docs, labels), gains), "ABCDE", gains)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM d),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
  count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, n, good, toxic, fails,
  contains(fails, substr(filter_order, step, 1)) AS failed, regexp_matches(fails, '[' || substr(filter_order, 1, step - 1) || '-]') AS earlier
  FROM n, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT failed AND NOT earlier), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (failed AND NOT earlier), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (failed AND earlier), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (failed AND NOT earlier), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (failed AND NOT earlier), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""
