"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

A window is 13 consecutive words of an item; a shorter item is one window. The rule is exact
containment, so all shingles of a window must occur in the document, at its places; a window needs
to be looked up by one of them only, its rarest (a prefix of length one in the order of rarity).

1. The benchmark's shingles (5 words, or the whole window if it is shorter) are looked up in all
   documents; what is found, with its places, is written once.
2. Its counts order each window's shingles. A window that has a shingle without any place cannot
   occur and goes. Each other window keeps its rarest shingle.
3. A found place of that shingle puts the window at one place of the document; places before the
   text's start or past its end go (positional and length bounds).
4. What remains is confirmed word by word against the document's own words.

Everything runs in DataFrame expressions. The benchmark's shingles are broadcast if they are
few enough (they are counted first), else joined by a shuffle.

Null and empty texts have no words: all counts are 0 and nothing is contaminated; an empty benchmark
contaminates nothing, and empty documents give no rows. Items without words or with a null item_id never count.
Of a window's equally rare shingles the first is looked up. Very long texts are read whole. Rows of equal doc_id
and text get equal results. Other columns are kept by decontaminated(), but for those named like its results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, packed, small_enough, table, unpacked

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class DecontaminationOptions:
    window: int = 13
    shingle: int = 5
    times: int = 20  # contaminated: times * hit words >= words
    broadcast_rows: int = 500_000


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, NOT_WORD), "")


def words(text: Column) -> Column:
    """The words of the A-Z-folded text."""
    return _split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def _hash(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(w, at + k) for k in range(n)))


def _shingles(w: Column, size: Column, n: int) -> Column:
    """Hashes of the n-word shingles of an array of at least n words."""
    return F.transform(F.sequence(F.lit(0), size - n), lambda i: _hash(w, i, n))


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if small_enough(df, rows) else df


def contamination(docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """dkey, hits (array of (start, size) of confirmed windows), items (sorted item ids as strings) of documents with any."""
    size, q = options.window, options.shingle
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    spans = items.withColumn("size", F.least(F.lit(size), F.size("w"))).select("item", "w", "size", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("at"))
    spans = spans.select("item", "size", F.expr("array_join(slice(w, at + 1, size), ' ')").alias("words"))
    owners = materialize(spans.select("item", "words").distinct(), "window-items")
    windows = materialize(spans.select("words", "size").distinct(), "windows")  # words hold no blank, so they tell the size
    each = F.least(F.lit(q), F.col("size"))
    tokens = None
    sizes = sorted(r[0] for r in windows.select(each.alias("q")).distinct().collect())
    for n in sizes:
        one = windows.where(each == n).select("words", "size", F.posexplode(_shingles(F.split("words", " "), F.col("size"), n)).alias("k", "token"), F.lit(n).alias("q"))
        tokens = one if tokens is None else tokens.union(one)
    if tokens is None:
        return docs.select("dkey", F.array().cast("array<struct<start:int,size:int>>").alias("hits"), F.array().cast("array<string>").alias("items")).limit(0)
    tokens = materialize(tokens, "window-tokens")

    held = docs.select("dkey", words(F.col("text")).alias("w"))
    found = None
    for n in sizes:
        places = held.where(F.size("w") >= n).select("dkey", F.posexplode(_shingles(F.col("w"), F.size("w"), n)).alias("pos", "token"))
        wanted = tokens.where(F.col("q") == n).select("token").distinct()
        here = places.join(_few(wanted, options.broadcast_rows), "token", "left_semi")
        found = here if found is None else found.union(here)
    found = materialize(found, "window-places")

    counts = found.groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "token", "left").groupBy("words", "size").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min(F.struct("n", "k", "token")).alias("rarest"))
    keys = materialize(ranked.where(F.col("least") > 0).select("words", "size", F.col("rarest.k").alias("k"), F.col("rarest.token").alias("token")), "window-keys")
    placed = found.join(_few(keys, options.broadcast_rows), "token").select("dkey", (F.col("pos") - F.col("k")).alias("start"), "size", "words").where(F.col("start") >= 0)
    by_doc = materialize(placed.groupBy("dkey").agg(F.collect_set(F.struct("start", "size", "words")).alias("places")), "window-candidates")

    texts = docs.select("dkey", "text").join(_few(by_doc, options.broadcast_rows // 10), "dkey")
    here = lambda w: lambda p: (p["start"] + p["size"] <= F.size(w)) & (F.array_join(F.slice(w, p["start"] + 1, p["size"]), " ") == p["words"])
    # the lambda's w is split once a row; a column's would be split again for each place
    confirmed = F.get(F.transform(F.array(words(F.col("text"))), lambda w: F.filter("places", here(w))), 0)
    true = materialize(texts.select("dkey", confirmed.alias("places")).where(F.size("places") > 0), "window-hits")
    names = true.select("dkey", F.explode(F.array_distinct(F.transform("places", lambda p: p["words"]))).alias("words")).join(_few(owners, options.broadcast_rows), "words")
    names = names.groupBy("dkey").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spots = true.select("dkey", F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size"))).alias("hits"))
    return spots.dropDuplicates(["dkey"]).join(names, "dkey")


def decontaminated(docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """docs with n_words, n_hit, items (sorted, as strings) and contaminated; these replace columns of their names."""
    keyed = packed(docs, "doc_id", "text").withColumn("dkey", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    found = materialize(contamination(keyed.select("dkey", "text"), benchmark, options), "contamination")
    spots = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    found = found.select("dkey", F.size(spots).cast("long").alias("n_hit"), "items")
    out = keyed.withColumn("n_words", F.size(words(F.col("text"))).cast("long")).join(_few(found, options.broadcast_rows // 10), "dkey", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(options.times) * F.col("n_hit") >= F.col("n_words")))
    return unpacked(out, docs, ("doc_id", "text"), "n_words", "n_hit", "items", "contaminated")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    joined = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined.alias("items_sha256"), "contaminated")


_FOLDED = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP9_SQL = f"""
WITH dw AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
bw AS (SELECT item_id, w, least(13, len(w)) AS l FROM (SELECT item_id, {_FOLDED} AS w FROM benchmark) WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM bw)),
lens AS (SELECT DISTINCT l FROM bwin),
dwin AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS t FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens WHERE len(w) >= l)),
occ AS (SELECT DISTINCT d.doc_id, d.l, d.i, b.item_id FROM dwin d JOIN bwin b ON d.t = b.t AND d.l = b.l),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS j FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.j, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
