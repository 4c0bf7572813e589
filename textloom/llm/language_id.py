"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to ``order`` bytes is learnt from a bounded
sample of labelled rows; escape method C gives every context a full distribution over the
next byte (symbols that the context has seen, else the shorter context's, with the seen
ones excluded). With the statistics frozen, a text's exact code length under a language is
a sum of table entries, one for each byte, so scoring is a gather over whole texts.

A-Z and a-z share a symbol. Null texts and texts without a letter get ``und`` and score 0.
With no labelled row at all everything is ``und``. Ties go to the language that sorts first.
Repeated rows are scored alike; other columns of the input are ignored. Texts of any length are scored
whole; an empty table gives no rows. A language whose rows are few or very long keeps one row in the sample at least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, fold, table

WINDOW = 1 << 21  # bytes that are scored at a time


@dataclass(frozen=True)
class LanguageIdOptions:
    order: int = 3  # longest context in bytes; 3 at most
    sample_rows: int = 2000  # labelled rows for each language, about; more would not change the statistics much
    sample_chars: int = 4_000_000  # characters of a language's sample, about; its rows are longer or shorter than others'


def _symbols(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return np.where(up, data + 32, data).astype(np.uint8)


def _history(s: np.ndarray, starts: np.ndarray, pad: int, order: int) -> list[np.ndarray]:
    """The symbols 1..order places before each position; pad before a text's first byte."""
    out = []
    for k in range(1, order + 1):
        h = np.empty_like(s)
        h[k:] = s[: len(s) - k] if k < len(s) else s[:0]
        h[:k] = pad
        for j in range(k):
            at = starts + j
            h[at[at < len(s)]] = pad
        out.append(h)
    return out


def _count(order: int):
    def run(batches):
        for b in batches:
            langs = b.column("lang").to_pylist()
            data, off = buffers(b.column("text"))
            s = _symbols(data).astype(np.uint64)
            by: dict[str, list[np.ndarray]] = {}
            for i, lang in enumerate(langs):
                t = s[off[i] : off[i + 1]]
                t = np.concatenate([np.full(order, 32, np.uint64), t])
                code = np.zeros(max(0, len(t) - order), np.uint64)
                for k in range(order + 1):
                    code |= t[k : k + len(code)] << np.uint64(8 * (order - k))
                by.setdefault(lang, []).append(code)
            for lang, codes in by.items():
                g, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return run


def _distribution(grams: np.ndarray, counts: np.ndarray, size: int, order: int) -> dict[int, dict[int, np.ndarray]]:
    """depth -> {context code: distribution over the symbols}; escape method C with exclusion."""
    out: dict[int, dict[int, np.ndarray]] = {}
    for depth in range(order + 1):
        code = grams % (size ** (depth + 1))  # the last depth symbols and the next one
        order_by = np.argsort(code, kind="stable")
        cs, ns = code[order_by], counts[order_by]
        cut = np.flatnonzero(np.r_[True, cs[1:] != cs[:-1]]) if len(cs) else np.zeros(0, int)
        total = np.add.reduceat(ns, cut) if len(cut) else ns
        cs = cs[cut]
        ctx, sym = cs // size, cs % size
        at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(cs) else np.zeros(0, int)
        rows = {}
        for a, z in zip(at, np.r_[at[1:], len(cs)], strict=True):
            c = int(ctx[a])
            parent = out[depth - 1].get(c % size ** (depth - 1)) if depth else None
            if parent is None:
                parent = np.full(size, 1 / size)
            n, d = total[a:z].sum(), z - a
            seen = np.zeros(size, bool)
            seen[sym[a:z]] = True
            rest = parent[~seen].sum()
            p = np.empty(size)
            if rest > 0:
                p[~seen] = parent[~seen] * (d / (n + d) / rest)
                p[sym[a:z]] = total[a:z] / (n + d)
            else:
                p[sym[a:z]] = total[a:z] / n
            rows[c] = p
        out[depth] = rows
    return out


@dataclass
class PpmModel:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    size: int
    order: int
    node: np.ndarray  # code of a full context -> row of log
    log: np.ndarray  # (rows * size, languages): natural logs

    @classmethod
    def fit(cls, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int) -> PpmModel:
        languages = sorted(set(lang.tolist()))
        raw = np.stack([(gram >> (8 * (order - k))) & 255 for k in range(order + 1)], 1) if len(gram) else np.zeros((0, order + 1), np.int64)
        used = np.union1d(np.unique(raw), [32]).astype(int)
        symbol = np.full(256, len(used), np.uint32)  # the last symbol is any byte that was not seen
        symbol[used] = np.arange(len(used))
        for k in range(65, 91):
            symbol[k] = symbol[k + 32]
        size = len(used) + 1
        coded = np.zeros(len(raw), np.int64)
        for k in range(order + 1):
            coded = coded * size + symbol[raw[:, k]]
        trees = [_distribution(coded[lang == x], n[lang == x].astype(float), size, order) for x in languages]
        contexts = [sorted(set().union(*(t[d] for t in trees))) for d in range(order + 1)]
        base = np.cumsum([0, *(len(c) for c in contexts)])
        node = np.zeros(size**order, np.int32)
        log = np.empty((base[-1], size, len(languages)), np.float32)
        for depth in range(order + 1):
            span = size**depth
            grid = node.reshape(-1, span)
            for i, c in enumerate(contexts[depth]):
                row = base[depth] + i
                grid[:, c] = row
                for k, t in enumerate(trees):
                    p = None
                    for d in range(depth, -1, -1):
                        p = t[d].get(c % size**d)
                        if p is not None:
                            break
                    log[row, :, k] = np.log(p) if p is not None else -np.log(size)
        return cls(languages, symbol, size, order, node, log.reshape(-1, len(languages)))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log-probability of each whole text under each language."""
        out = np.zeros((len(off) - 1, len(self.languages)))
        full = np.flatnonzero(off[1:] > off[:-1])
        starts = off[full]
        pad = int(self.symbol[32])
        for a in range(0, len(data), WINDOW):
            z = min(len(data), a + WINDOW)
            lead = min(self.order, a)
            s = self.symbol[data[a - lead : z]]
            lo, hi = np.searchsorted(starts, [a - lead, z])
            inside = starts[lo:hi] - (a - lead)
            ctx = np.zeros(len(s), np.uint32)
            for h in reversed(_history(s, inside, pad, self.order)):
                ctx *= np.uint32(self.size)
                ctx += h
            row = self.node[ctx[lead:]].astype(np.int64) * self.size + s[lead:]
            got = self.log[row]
            first = np.searchsorted(starts, a, "right") - 1
            cut = np.maximum(starts[first:hi] - a, 0)
            out[full[first:hi]] += np.add.reduceat(got, cut, axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, options: LanguageIdOptions = LanguageIdOptions()) -> PpmModel | None:
    """A model from rows with a lang. The sample is drawn by a hash of the row over all of docs."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    scale = 1 << 30
    at = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(scale))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("count"), F.sum(F.length("text").cast("double")).alias("chars"), F.min(at).alias("least")).collect()  # a row a language
    if not sizes:
        return None
    drawn = lambda r: int(min(scale, scale * options.sample_rows // r["count"] + 1, scale * options.sample_chars // (r["chars"] + 1) + 1))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], max(drawn(r), r["least"] + 1))))  # the row of the least hash always
    sample = rows.where(at < F.coalesce(share[F.col("lang")], F.lit(0))).select("lang", "text")
    grams = sample.mapInArrow(_count(options.order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = grams.toArrow()
    if not got.num_rows:
        return None
    return PpmModel.fit(np.array(got["lang"].to_pylist(), object), got["gram"].to_numpy(), got["n"].to_numpy(), options.order)


def predict(docs: DataFrame, model: PpmModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, score (the posterior of lang_pred under equal priors)."""
    slim = docs.select(*keep, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    if model is None:
        return slim.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [slim.schema[k] for k in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches):
        m: PpmModel = shared.value
        names = np.array([*m.languages, "und"], object)
        for b in batches:
            total = m.score(*buffers(b.column("text")))
            best = total.argmax(1) if len(total) else np.zeros(0, int)
            top = 1 / np.exp(total - total[np.arange(len(total)), best][:, None]).sum(1) if len(total) else np.zeros(0)
            letters = b.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            pred = np.where(letters, best, len(m.languages))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names[pred], pa.string()), pa.array(np.where(letters, top, 0.0))], names=[*keep, "lang_pred", "score"])

    return slim.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 3) == 1)
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, ("doc_id", "held_out"))
