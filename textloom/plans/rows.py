"""Queries without an SQL twin; tests/test_operators.py holds their operators against other means."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import placeholder, tokens
from ..operators import delimited, diff, render
from .registry import query, spread, table

@query()
def turn_diffs(spark, sf_dir):
    """Lines of each turn against the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text", F.lag("text").over(w).alias("before")).where("before is not null")
    return diff.diff_stats(diff.line_diff(pairs, "id", "before", "text"), "id")


@query()
def delimited_parse(spark, sf_dir):
    return delimited.ragged(delimited.parse(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query()
def json_beautified(spark, sf_dir):
    return render.beautify(table(spark, sf_dir, "events"), "event_id", "props").select("event_id", "output")


@query()
def generated_ids(spark, sf_dir):
    out = table(spark, sf_dir, "customer").select("c_custkey")
    for kind in ("v4", "v7", "ulid", "nanoid"):
        out = tokens.identifiers(out, kind, 1_700_000_000_000).withColumnRenamed("id", kind)
    return out


@query()
def placeholder_texts(spark, sf_dir):
    """Placeholder paragraphs of each part, seeded by its name and key."""
    seed = F.concat_ws("-", "p_name", "p_partkey")
    made = {f: placeholder.blocks(seed, flavour=f) for f in placeholder.WORDS}
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", *(placeholder.formatted(b, form="html").alias(f) for f, b in made.items()))


@query()
def sealed_turns(spark, sf_dir):
    """Turns sealed and opened again; each role has its own salt, so that a few keys are derived."""
    turns = table(spark, sf_dir, "conversations").withColumn("said", F.col("text"))
    salt = F.unhex(F.md5(F.col("role").cast("binary")))
    opened = tokens.decrypt(tokens.encrypt(turns, "text", "a long passphrase", salt), "text", "a long passphrase")
    return opened.select("conv_id", "turn", F.col("text").eqNullSafe(F.col("said")).alias("same"), "error")
