"""Language-model scores: subword lattice likelihood, beside an add-one word baseline.

Tokens are the words of the A-Z-folded text and one end. The lattice model spells each word, with
a space in front, by all segmentations into vocabulary pieces; the existing vocabulary scores
weight them, and the training words' expected piece counts, taken once over all of them under
those scores, are added to the scores as to a prior of ``prior`` pieces. A log-space forward
recursion gives a word's marginal probability; no piece crosses a word's start, so a document's
marginal is the product over its words, times the end's probability.

The word counts of all training rows are one Spark table. A document's words of the most frequent
``head_words`` are looked up in a broadcast of that proven size; its other words go through a
shuffled join with the rest of the table, so every count is used at any vocabulary size.

Null texts are empty: only the end. Repeated rows each get their own result (rows are told apart
by their place in the scan, not by doc_id). Without training rows N = V = 0 and the counts are all
0. Very long words are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, table
from .pieces import DEFAULT_VOCABULARY, Pieces, add_expected, loaded, log_totals, read_vocabulary

FLUSH = 300_000  # words that a task counts before it hands them on
REMEMBER = 300_000  # words whose marginals a worker remembers
STRETCH = 60_000  # distinct words of documents that are scored together
LN10 = math.log(10)


@dataclass(frozen=True)
class LmOptions:
    vocabulary: str = DEFAULT_VOCABULARY
    head_words: int = 200_000
    prior: float = 10_000.0  # pieces that the vocabulary's scores count for against the training words


def _texts(column: pa.Array):
    for t in column:
        t = t.as_buffer()
        yield b"" if t is None else t.to_pybytes()


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # both know ASCII only: A-Z, and \x20 \x09-\x0D


def _count(batches):
    held: Counter = Counter()

    def rows():
        words, n = pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())
        return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

    for b in batches:
        for text in _texts(b.column("text").cast(pa.binary())):
            held.update(_words(text))
            held[b""] += 1  # the end; no word is empty
            if len(held) > FLUSH:
                yield rows()
                held.clear()
    if held:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all rows; the end is the empty word."""
    slim = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _expect(proto):
    def run(batches):
        p = loaded(proto.value)
        into = np.zeros(p.size)
        for b in batches:
            add_expected(p, [" " + w for w in b.column("word").to_pylist()], b.column("n").to_pylist(), into)
        has = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(into[has])], names=["piece", "n"])

    return run


@dataclass
class LatticeModel:
    log_weight: np.ndarray
    log_end: float


def fit_lattice(counts: DataFrame, ends: int, options: LmOptions, proto) -> LatticeModel:
    """Piece weights from the words' expected piece counts; one row a piece reaches the driver."""
    p = Pieces(proto.value)
    got = counts.where(F.col("word") != "").mapInArrow(_expect(proto), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(p.size)
    n[got["piece"].to_numpy()] = got["n"].to_numpy()
    total = n.sum()
    weight = n + options.prior * np.exp(p.log_weight)
    end = (ends + 0.5) / (ends + total + 1)
    with np.errstate(divide="ignore"):
        return LatticeModel(np.log(weight / weight.sum()) + math.log1p(-end), math.log(end))


def _score(shared):
    def run(batches):
        proto, model, head, rare = shared.value
        p = loaded(proto, model.log_weight)
        remembered: dict[bytes, float] = {}
        part, row = TaskContext.get().partitionId() << 34, 0

        def learn(words: dict[bytes, int]) -> None:
            for w, x in zip(words, log_totals(p, [" " + w.decode() for w in words]), strict=True):
                remembered[w] = x

        for b in batches:
            out: list[tuple] = []
            tail: list[bytes] = []
            tf: list[int] = []
            cut = [0]
            held: list[Counter] = []
            size = 0

            def flush() -> None:
                nonlocal held, size, row
                if len(remembered) > REMEMBER:
                    remembered.clear()
                learn(dict.fromkeys(w for words in held for w in words if w not in remembered))
                for words in held:
                    n, known, logs, lattice = 1, 0, 0.0, model.log_end
                    for w, k in words.items():
                        n += k
                        lattice += k * remembered[w]
                        c = head.get(w)
                        if c is not None:
                            known += k
                            logs += k * c
                        elif rare:
                            tail.append(w)
                            tf.append(k)
                    if (c := head.get(b"")) is not None:
                        known += 1
                        logs += c
                    out.append((part + row, n, known, logs, lattice / LN10))
                    cut.append(len(tail))
                    row += 1
                held, size = [], 0

            for text in _texts(b.column("text").cast(pa.binary())):
                held.append(Counter(_words(text)))
                size += len(held[-1])
                if size > STRETCH:
                    flush()
            flush()
            rid, n, known, logs, lattice = zip(*out, strict=True) if out else ((),) * 5
            words = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(tail, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(rid, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(lattice, pa.float64()), words, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(tf, pa.int32()))],
                names=["doc_id", "held_out", "rid", "n_tokens", "known", "logs", "score", "words", "tf"],
            )

    return run


def lm_scores(docs: DataFrame, options: LmOptions = LmOptions()) -> DataFrame:
    """docs: doc_id, text, held_out. Learns from the rows that are not held out, scores all."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs.where(~F.col("held_out"))), "lm-counts")
    n, v, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("n")))).first()
    n, ends = n or 0, ends or 0
    # the least count whose words, all together, still fit the head
    least, room = None, options.head_words
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(options.head_words).toLocalIterator():
        room -= r["count"]
        if room < 0:
            break
        least = r["n"]
    # the end takes part even where it is rare
    frequent = F.col("n") >= least if least is not None else F.lit(False)
    top = counts.where(frequent | (F.col("word") == "")).toArrow()
    head = {w.encode(): math.log10(c + 1) for w, c in zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)}
    proto = read_vocabulary(options.vocabulary)
    rare = v > len(head)
    model = fit_lattice(counts, ends, options, spark.sparkContext.broadcast(proto))
    shared = spark.sparkContext.broadcast((proto, model, head, rare))
    slim = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(slim.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, rid long, n_tokens long, known long, logs double, score double, words array<string>, tf array<int>"), "lm-rows")
    result = rows.select("doc_id", "held_out", "rid", "n_tokens", "known", "logs", "score")
    if rare:
        tail = rows.select("rid", F.explode(F.arrays_zip("words", "tf")).alias("t")).select("rid", F.col("t.words").alias("word"), F.col("t.tf").alias("tf"))
        rest = counts.where(~frequent & (F.col("word") != ""))
        sums = tail.join(rest, "word").groupBy("rid").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more_logs"))
        result = result.join(sums, "rid", "left").withColumn("known", F.col("known") + F.coalesce("more", F.lit(0))).withColumn("logs", F.col("logs") + F.coalesce("more_logs", F.lit(0.0)))
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return result.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 7) == 2)
    return lm_scores(docs)
