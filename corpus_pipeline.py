"""From documents to sampled pieces: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four
return the columns of documents; the last returns doc_id, ids, n_pieces and lossless.

Null and empty texts have no lines, shingles or windows, so no stage but the classifier could let them
go. Every stage takes texts of any length whole, treats equal rows alike (near-duplicates keep one of them), and gives an empty table for
an empty one. Of documents that are alike the one of the smallest doc_id stays, and of equal lines the first.
Columns besides doc_id and text travel in a struct, so that their names can't clash; n_chars follows a text
that lost lines. The last stage leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, line_dedup, minhash_forest, sentencepiece_sampling, toxicity
from textloom.llm.common import materialize, packed, table, unpacked

#: What the stages work on; the other columns go along untouched.
NAMED = ("doc_id", "text")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(toxicity.predict(packed(docs, *NAMED), chain).where(~F.col("rejected")), docs, NAMED)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier match go; documents stay, if need be with an empty text."""
    out = line_dedup.dedup_lines(packed(docs, *NAMED))
    row = F.col("_row")
    if "n_chars" in docs.columns:
        now = F.when(F.size("removed") == 0, F.col("_row.n_chars")).otherwise(F.length("deduped"))
        row = row.withField("n_chars", now.cast(docs.schema["n_chars"].dataType))
    return unpacked(out.select("doc_id", F.col("deduped").alias("text"), row.alias("_row")), docs, NAMED)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8, as for lines) stays: that of the smallest doc_id."""
    return minhash_forest.drop_near_duplicates(docs, minhash_forest.ForestOptions(similarity=80))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    out = decontamination.decontaminated(packed(docs, *NAMED), table(spark, sf_dir, "benchmark"))
    return unpacked(out.where(~F.col("contaminated")), docs, NAMED)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, and whether decoding them gives the text back."""
    out = sentencepiece_sampling.encode_rows(docs)
    return out.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "lossless")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: Classifiers, forests and samples have no SQL twin; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
