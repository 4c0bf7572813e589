"""Matching and ranking: affinity, containment, link audits, search, related items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def affinity(df: DataFrame, group: str, text: str, limit: int = 4) -> DataFrame:
    """group, other, overlap, place: groups by the words longer than three letters that they share.

    Each group's distinct words come first, so the self-join on the word sees a row for each word and group.
    """
    words = df.where(F.col(group).isNotNull()).select(group, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+", -1))).alias("word"))
    words = words.where(F.length("word") > 3).distinct()
    pairs = words.join(words.withColumnRenamed(group, "other"), "word").where(F.col(group) != F.col("other"))
    counts = pairs.groupBy(group, "other").agg(F.count("*").alias("overlap"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("overlap"), "other"))).where(F.col("place") <= limit)


def search_score(name: Column, query: str) -> Column:
    """4 exact, 3 prefix, 2 prefix of a word, 1 inside, 0."""
    n, q = F.lower(name), query.lower()
    return F.when(n == q, 4).when(n.startswith(q), 3).when(n.contains(f" {q}"), 2).when(n.contains(q), 1).otherwise(0)


def search(df: DataFrame, name: str, query: str, rank: str, limit: int = 12, key: str | None = None) -> DataFrame:
    """The best matches; an empty query ranks by rank alone. Of rows alike in all that, those of the smallest key come first."""
    last = [] if key is None else [key]
    if not query:
        return df.withColumn("match", F.lit(0)).orderBy(F.desc(rank), name, *last).limit(limit)
    return df.withColumn("match", search_score(F.col(name), query)).where("match > 0").orderBy(F.desc("match"), F.desc(rank), name, *last).limit(limit)


def phrase_present(text: Column, phrase: Column) -> Column:
    """Whether a text has a phrase: between spaces, with an s more or less, or between word edges.

    All of the text but letters, digits and + # . / - counts as a space; phrases are lower-case.
    """
    return phrase_in(spaced_words(text), phrase)


def spaced_words(text: Column) -> Column:
    """The text in which phrase_in() looks; a column of its own where many phrases are looked for in a text."""
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9+#./ -]", " "), r"\s+", " "), F.lit(" "))


def phrase_in(plain: Column, phrase: Column) -> Column:
    spaced = lambda p: F.contains(plain, F.concat(F.lit(" "), p, F.lit(" ")))
    quoted = F.regexp_replace(phrase, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    b = r"(?:(?<=[a-z0-9_])(?![a-z0-9_])|(?<![a-z0-9_])(?=[a-z0-9_]))"
    # a pattern of its own is made for each phrase: only where its letters stand in the text at all
    edged = F.contains(plain, phrase) & F.regexp_like(plain, F.concat(F.lit(b), quoted, F.lit(b)))
    less = phrase.endswith("s") & spaced(F.substring(phrase, F.lit(1), F.length(phrase) - 1))
    return spaced(phrase) | spaced(F.concat(phrase, F.lit("s"))) | less | edged


def link_audit(nodes: DataFrame, edges: DataFrame, key: str, src: str, dst: str, always: int = 2, weak: int = 5) -> DataFrame:
    """key, inbound, outbound, is_orphan, is_weak; always: links that every node has."""
    into = edges.where(F.col(src) != F.col(dst)).groupBy(F.col(dst).alias(key)).agg(F.countDistinct(src).alias("i"))
    out = edges.groupBy(F.col(src).alias(key)).agg(F.countDistinct(dst).alias("o"))
    both = nodes.select(key).join(into, key, "left").join(out, key, "left")
    inbound, outbound = F.coalesce("i", F.lit(0)) + always, F.coalesce("o", F.lit(0)) + always
    return both.select(key, inbound.alias("inbound"), outbound.alias("outbound"), F.col("i").isNull().alias("is_orphan"), (inbound < weak).alias("is_weak"))


def link_bands(audit: DataFrame, n_broken: DataFrame, weak: int = 5, least: int = 8, most: int = 12) -> DataFrame:
    """One row on a whole audit: nodes, orphans, weak ones (that are none), too few and too many links out, broken links, failed.

    The audit fails where there are orphans or broken links. n_broken: one row, one count.
    """
    of = audit.agg(
        F.count("*").alias("nodes"),
        F.count_if("is_orphan").alias("orphans"),
        F.count_if(~F.col("is_orphan") & (F.col("inbound") < weak)).alias("weak"),
        F.count_if(F.col("outbound") < least).alias("few_out"),
        F.count_if(F.col("outbound") > most).alias("many_out"),
    )
    both = of.crossJoin(F.broadcast(n_broken.toDF("broken")))  # a row and a row
    return both.withColumn("failed", (F.col("orphans") > 0) | (F.col("broken") > 0))


def broken_links(nodes: DataFrame, edges: DataFrame, key: str, src: str, dst: str) -> DataFrame:
    return edges.join(nodes.select(F.col(key).alias(dst)), dst, "left_anti").select(src, dst).distinct()


def related(items: DataFrame, explicit: DataFrame, key: str, cluster: str, category: str, rank: str, limit: int = 8) -> DataFrame:
    """key, other, priority, place: explicit links, then the cluster's best, then the category's; each once.

    The best ``limit`` + 1 of each cluster and category are enough for every item in it, so the
    joins grow with the items, not with the square of a group.
    """

    def best(group: str) -> DataFrame:
        w = Window.partitionBy(group).orderBy(F.desc(rank), key)
        return items.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * limit + 1).select(group, F.col(key).alias("other"), F.col(rank).alias("score"))

    named = explicit.join(items.select(F.col(key).alias("other"), F.col(rank).alias("score")), "other").select(key, "other", "score", F.lit(1).alias("priority"))
    near = items.select(key, cluster).join(best(cluster), cluster).select(key, "other", "score", F.lit(2).alias("priority"))
    far = items.select(key, category).join(best(category), category).select(key, "other", "score", F.lit(3).alias("priority"))
    every = named.union(near).union(far).where(F.col(key) != F.col("other")).groupBy(key, "other").agg(F.min("priority").alias("priority"), F.max("score").alias("score"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("priority", F.desc("score"), "other"))).where(F.col("place") <= limit).drop("score")


def merge_intervals(df: DataFrame, key: str, start: str, end: str, least_gap: int = 6) -> DataFrame:
    """key, months, n_spans, n_gaps of month intervals, both ends included; adjacent ones join."""
    w = Window.partitionBy(key).orderBy(start, end)
    seen = df.select(key, start, end).withColumn("before", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = seen.withColumn("island", F.sum((F.col("before").isNull() | (F.col(start) > F.col("before") + 1)).cast("int")).over(w))
    spans = marked.groupBy(key, "island").agg(F.min(start).alias("s"), F.max(end).alias("e"))
    gaps = spans.withColumn("gap", F.col("s") - F.lag("e").over(Window.partitionBy(key).orderBy("s")) - 1)
    return gaps.groupBy(key).agg(F.sum(F.col("e") - F.col("s") + 1).alias("months"), F.count("*").alias("n_spans"), F.count_if(F.col("gap") >= least_gap).alias("n_gaps"))
