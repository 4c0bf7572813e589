"""Toxicity by a classifier chain over hashed words.

The label columns form a chain in their given order. Each link is a logistic regression over the
words, and beginnings of words, that tell its classes apart, and over the earlier links'
probabilities. A link takes the features whose likelihood ratio against independence of the class is
``least_ratio`` or more, the best ``most`` of them, and fits their weights by Newton's method. For training, the earlier
probabilities are out-of-fold: each row's come from models fitted (features and weights) without
its fold, so that a later link learns from estimates as honest as those it meets when it predicts.

The links are fitted on a sample of labelled rows, bounded by ``sample_rows`` (the rows of the
rarer toxic class are kept first, the rest drawn by a hash of the id); prediction covers all rows
and whole texts. Rows whose ids repeat in the labels are used once (the largest label). Null and
empty texts have no words and get the probabilities of the intercepts but are never rejected.
With no labelled rows, all probabilities are 0 and nothing is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import bounded_batches, packed, release, released, small_enough, table, unpacked

REMEMBER = 200_000  # words whose feature a worker remembers
EDGE = b".,;:!?\"'()[]{}|*#-"  # outer punctuation


@dataclass(frozen=True)
class ToxicityOptions:
    chain: tuple[str, ...] = ("quality", "toxic")  # label columns; the last decides
    features: int = 1 << 24  # buckets of hashed words and beginnings
    beginning: int = 5  # bytes
    sample_rows: int = 8_000
    folds: int = 3
    least_ratio: float = 12.0
    most: int = 400
    l2: float = 0.05
    threshold: float = 0.5


class _Words(dict):
    """Of a word its feature and its beginning's, as far as wanted has them: their places there, or else -1.
    Without wanted, the features themselves."""

    def __init__(self, options: ToxicityOptions, wanted: np.ndarray | None = None):
        self.size, self.n = options.features, options.beginning
        self.places = None if wanted is None else {int(f): k for k, f in enumerate(wanted)}
        self.none = (-1, -1)

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > REMEMBER:
            self.clear()
        bare = word.strip(EDGE)
        whole = xxhash.xxh64_intdigest(bare) % self.size if bare else -1
        begin = xxhash.xxh64_intdigest(bare[: self.n], 1) % self.size if len(bare) > self.n else -1
        found = (whole, begin) if self.places is None else (self.places.get(whole, -1), self.places.get(begin, -1))
        if found == self.none:
            found = self.none  # one tuple for the many
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: bytes) -> list[int]:
        """Distinct features of the A-Z-folded words without their outer punctuation."""
        return sorted({f for pair in set(map(self.__getitem__, set(text.lower().split()))) for f in pair if f >= 0})


class Sparse:
    """Rows of distinct features."""

    def __init__(self, rows: list[np.ndarray]):
        n = np.array([len(r) for r in rows], np.int64)
        self.col = np.concatenate(rows).astype(np.int32, copy=False) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        self.n = len(rows)

    def dense(self, wanted: np.ndarray) -> np.ndarray:
        """Which rows have which of the wanted (sorted) features."""
        out = np.zeros((self.n, len(wanted)))
        if len(wanted):
            at = np.minimum(np.searchsorted(wanted, self.col), len(wanted) - 1)
            on = wanted[at] == self.col
            out[self.row[on], at[on]] = 1
        return out

    def take(self, keep: np.ndarray) -> Sparse:
        out = object.__new__(Sparse)
        on = keep[self.row]
        out.col, out.row, out.n = self.col[on], (np.cumsum(keep, dtype=np.int32) - np.int32(1))[self.row[on]], int(keep.sum())
        return out


def telling(x: Sparse, y: np.ndarray, options: ToxicityOptions) -> np.ndarray:
    """The features that depend most on the class, by the likelihood ratio of their fourfold table, sorted."""
    if not len(x.col):
        return np.zeros(0, np.int64)
    feature, has = np.unique(x.col, return_counts=True)
    mine, n_mine = np.unique(x.col[(y == 1)[x.row]], return_counts=True)
    has, pos = has.astype(float), np.zeros(len(feature))
    pos[np.searchsorted(feature, mine)] = n_mine
    n, n_pos = len(y), y.sum()
    ratio = np.zeros(len(feature))
    for seen, rows, columns in ((pos, has, n_pos), (has - pos, has, n - n_pos), (n_pos - pos, n - has, n_pos), (n - n_pos - has + pos, n - has, n - n_pos)):
        some = seen > 0
        ratio[some] += 2 * seen[some] * np.log(seen[some] * n / (rows[some] * columns))
    best = np.lexsort((feature, -ratio))[: options.most]
    return np.sort(feature[best[ratio[best] >= options.least_ratio]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Link:
    features: np.ndarray
    weights: np.ndarray  # of the features, then of the earlier probabilities, then the intercept

    def predict(self, has: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """has: which rows have which of the features."""
        n = len(self.features)
        return _sigmoid(has @ self.weights[:n] + extra @ self.weights[n:-1] + self.weights[-1])


def fit_link(x: Sparse, extra: np.ndarray, y: np.ndarray, options: ToxicityOptions) -> Link:
    """Newton's method on log-loss with a quadratic penalty; the commoner class weighs at most four times the rarer."""
    if not len(y):
        return Link(np.zeros(0, np.int64), np.zeros(extra.shape[1] + 1))
    wanted = telling(x, y, options)
    a = np.column_stack([x.dense(wanted), extra, np.ones(len(y))])
    pos, neg = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, min(1.0, 4 * max(neg, 1) / max(pos, 1)), min(1.0, 4 * max(pos, 1) / max(neg, 1)))
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], options.l2)
    ridge[-1] = 1e-3

    def loss(v: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ v)) + ridge @ (v * v) / 2)

    now = loss(w)
    for _ in range(50):
        p = _sigmoid(a @ w)
        curve = a.T @ (a * (weight * p * (1 - p))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(curve, a.T @ (weight * (y - p)) - ridge * w)
        while (after := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, gain, now = w + step, now - after, after
        if gain < 1e-7 * (1 + now):
            break
    return Link(wanted, w)


@dataclass
class Chain:
    names: tuple[str, ...]
    links: list[Link]

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, options: ToxicityOptions) -> Chain:
        x = Sparse(rows)
        extra = np.zeros((len(rows), 0))
        links = []
        for k in range(len(options.chain)):
            y, has = np.nan_to_num(labels[:, k]), ~np.isnan(labels[:, k])
            links.append(fit_link(x.take(has), extra[has], y[has], options))
            if k + 1 < len(options.chain):
                out = np.zeros(len(rows))
                for f in range(options.folds):
                    other, own = (fold != f) & has, fold == f
                    link = fit_link(x.take(other), extra[other], y[other], options)
                    out[own] = link.predict(x.take(own).dense(link.features), extra[own])
                extra = np.column_stack([extra, out])
        return cls(options.chain, links)

    def features(self) -> np.ndarray:
        return np.unique(np.concatenate([x.features for x in self.links]))

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """Each link's probabilities; rows: distinct features."""
        x = Sparse(rows)
        extra = np.zeros((len(rows), 0))
        for link in self.links:
            extra = np.column_stack([extra, link.predict(x.dense(link.features), extra)])
        return extra


def _features(options: ToxicityOptions):
    def run(batches):
        words = _Words(options)
        for b in batches:
            rows = [np.array(words.of(t.as_buffer().to_pybytes()), np.int32) for t in b.column("text").cast(pa.binary())]
            cut = np.r_[0, np.cumsum([len(r) for r in rows])]
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), lists], names=[*(c for c in b.schema.names if c != "text"), "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> Chain | None:
    last = options.chain[-1]
    by_id = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in options.chain))
    sizes = {r[last]: r["count"] for r in by_id.where(F.col(last).isNotNull()).groupBy(last).count().collect()}
    if not sizes:
        return None
    scale = 1 << 30
    half = options.sample_rows // 2
    rare = min(sizes.values())
    room = {k: half if len(sizes) > 1 and rare >= half else options.sample_rows - (rare if n != rare else 0) for k, n in sizes.items()}
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(scale, scale * room[k] // n))))
    at = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(scale))
    picked = by_id.where(at < F.coalesce(share[F.col(last)], F.lit(0)))
    if small_enough(picked, 2 * options.sample_rows):
        picked = F.broadcast(picked)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(picked, "doc_id")
    kinds = ", ".join(f"{c} double" for c in options.chain)
    # rows of equal ids in docs can't make the sample larger than its bound: those of the least hash of id and text stay
    slim = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("order"), *(F.col(c).cast("double").alias(c) for c in options.chain), "text")
    got = slim.mapInArrow(released(_features(options)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, order long, {kinds}, features array<int>").orderBy("order", "doc_id", "features").limit(2 * options.sample_rows).toArrow().sort_by([("doc_id", "ascending"), ("order", "ascending")])
    if not got.num_rows:
        return None
    y = np.column_stack([got[c].to_numpy() for c in options.chain])
    fold = np.array([xxhash.xxh64_intdigest(str(i)) % options.folds for i in got["doc_id"].to_pylist()])
    lists = got["features"].combine_chunks()
    cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    chain = Chain.fit([flat[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)], y, fold, options)
    del got, lists, cut, flat
    release()  # the driver's own memory, which the stages after this one need
    return chain


def predict(docs: DataFrame, chain: Chain | None, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """All columns of docs, then p_<category> for each category and rejected; these replace columns of their names."""
    probs = [f"p_{c}" for c in options.chain]
    slim = packed(docs, "text")
    if chain is None:
        return unpacked(slim.select("*", *(F.lit(0.0).alias(p) for p in probs), F.lit(False).alias("rejected")), docs, ("text",), *probs, "rejected")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((chain, chain.features()))  # at most options.most features a link
    schema = StructType([*slim.schema, *(StructField(p, DoubleType()) for p in probs), StructField("rejected", BooleanType())])
    threshold = options.threshold

    def run(batches):
        m, wanted = shared.value
        words = _Words(options, wanted)
        for b in batches:
            texts = [x.to_pybytes() if (x := t.as_buffer()) is not None else b"" for t in b.column("text").cast(pa.binary())]
            p = m.predict([wanted[words.of(t)] for t in texts])
            bad = (p[:, -1] >= threshold) & np.array([len(t) > 0 and not t.isspace() for t in texts], bool)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(bad)], names=[*b.schema.names, *probs, "rejected"])

    return unpacked(slim.mapInArrow(released(run), schema), docs, ("text",), *probs, "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    return predict(docs, chain).drop("text")
