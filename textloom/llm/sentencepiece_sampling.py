"""Reproducible sampled segmentation by forward filtering and backward sampling.

A text is cut into atoms (a word with the space before it, a line end, a space); the forward sums
of each distinct atom's lattice are built once in a stretch of text, and all occurrences of all its
atoms then walk back from their ends together, one sampled edge a step. The uniform for a step is a
hash of the row's key, the seed, the atom's place in the text and the step, so a row's
segmentation depends on nothing else: not on partitions, batches or other rows.

Decoding joins the pieces' bytes and drops the one space put in front; it restores every text
exactly, whatever white space, line ends or unknown characters it holds. Null texts have null ids;
an empty text has the ids of the single space put in front. Repeated keys with equal texts get
equal segmentations. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, released, table
from .pieces import DEFAULT_VOCABULARY, Lattices, Pieces, points, read_vocabulary, short

CHARS = 1 << 19  # text taken at a time


@dataclass(frozen=True)
class SamplingOptions:
    vocabulary: str = DEFAULT_VOCABULARY
    seed: int = 0
    alpha: float = 1.0  # exponent on the pieces' weights: 0 is uniform over segmentations, large is the best one


_PRIME = 0x9E3779B97F4A7C15
_forth = np.multiply.accumulate(np.r_[np.uint64(1), np.full(1 << 16, _PRIME, np.uint64)])


def _atoms(char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where atoms start, and a hash of each: a line end, a space with what follows it, or what follows a line end."""
    line = char == 10
    begin = line | (char == 32)
    begin[1:] |= line[:-1]
    begin[:1] = True
    start = np.flatnonzero(begin)
    end = np.r_[start[1:], len(char)]
    value = (char.astype(np.uint64) + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.arange(len(char)) - np.repeat(start, end - start)
    value *= _forth[np.minimum(at, len(_forth) - 1)]
    far = np.flatnonzero(at >= len(_forth))  # of a very long atom
    value[far] = mix64(value[far] + at[far].astype(np.uint64) * np.uint64(_PRIME))
    return start, mix64(np.add.reduceat(value, start) + (end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


class Sampler:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def sample(self, char: np.ndarray, start: np.ndarray, name: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each atom); name: a hash of each atom's characters, key: of each occurrence."""
        size = np.diff(np.r_[start, len(char)])
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        few = short(self.pieces, char, start[one], size[one])
        x = Lattices(self.pieces, char, start[one][few], size[one][few])
        place = np.full(len(one), -1)
        place[np.flatnonzero(few)[x.order]] = np.arange(len(x.order))
        t = place[which]
        count = np.zeros(len(start), np.int64)
        who = np.flatnonzero(t >= 0)
        t, d, k, step, steps = t[who], size[who], key[who], 0, []
        while len(who):
            h = mix64(k + np.uint64((step * _PRIME) & (2**64 - 1)))
            u = ((h >> np.uint64(41)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 23)
            node = x.base[d] + t
            rows = x.share[node]
            edge = (rows < (u * rows[:, -1])[:, None]).sum(1)  # the first edge with which the sum reaches u's part
            steps.append((who, x.piece[node, edge]))
            count[who] += 1
            d = d - edge - 1
            on = d > 0
            who, t, d, k = who[on], t[on], d[on], k[on]
            step += 1
        spelt = x.spelt
        alone = {i: self._walk(char[start[i] : start[i] + size[i]], int(key[i]), spelt) for i in np.flatnonzero(place[which] < 0).tolist()}
        for i, found in alone.items():
            count[i] = len(found)
        last = np.cumsum(count)
        ids = np.empty(int(last[-1]) if len(last) else 0, np.int32)
        for j, (w, c) in enumerate(steps):
            ids[last[w] - 1 - j] = c
        for i, found in alone.items():
            ids[last[i] - len(found) : last[i]] = found
        if len(odd := np.flatnonzero(ids < 0)):
            ids, count = self._spell(ids, count, odd, spelt)
        return ids, count

    def _walk(self, char: np.ndarray, key: int, spelt: list[list[int]]) -> list[int]:
        """One long atom's sample; its own lattice, in logs."""
        text = char.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        ends, d, step, out = self.pieces.edges(text), len(text), 0, []
        while d:
            h = int(mix64(np.array([(key + step * _PRIME) & (2**64 - 1)], np.uint64))[0])
            u = ((h >> 41) + 0.5) / (1 << 23)
            here = ends[d - 1]
            top = max(e[2] for e in here)
            sums = np.cumsum(np.exp(np.array([e[2] - top for e in here])))
            i, k, _ = here[min(len(here) - 1, int(np.searchsorted(sums, u * sums[-1])))]
            if k < 0:
                spelt.append(self.pieces.spelt(text[i]))
                k = -len(spelt)
            out.append(k)
            d, step = i, step + 1
        return out[::-1]

    def _spell(self, ids: np.ndarray, count: np.ndarray, odd: np.ndarray, spelt: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        spans = [spelt[-k - 1] for k in ids[odd].tolist()]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(s) for s in spans]
        out = np.repeat(ids, width)
        at = np.cumsum(width) - width
        for i, s in zip(at[odd].tolist(), spans, strict=True):
            out[i : i + len(s)] = s
        cut = np.r_[0, np.cumsum(count)]
        whole = np.r_[0, np.cumsum(width)]
        return out, whole[cut[1:]] - whole[cut[:-1]]

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text), a stretch of text at a time."""
        parts, sizes = [], np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        done = np.zeros(len(texts), np.int64)  # atoms of each text so far
        size = 0

        def flush() -> None:
            nonlocal held, owner, size
            if held:
                char = points("".join(held))
                start, name = _atoms(char)
                cut = np.r_[0, np.cumsum([len(p) for p in held])]
                n = np.diff(np.searchsorted(start, cut))
                who = np.array(owner)
                place = np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(done[who], n)
                key = mix64(place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.repeat(keys[who], n))
                ids, count = self.sample(char, start, name, key)
                parts.append(ids)
                np.add.at(sizes, np.repeat(who, n), count)
                done[who] += n
            held, owner, size = [], [], 0

        for t, text in enumerate(texts):
            for piece in _stretches(" " + text):
                if owner and owner[-1] == t:
                    flush()  # a text's next stretch goes on counting its atoms
                held.append(piece)
                owner.append(t)
                size += len(piece)
                if size >= CHARS:
                    flush()
        flush()
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), sizes


def _stretches(text: str):
    """text in stretches that end where an atom ends."""
    a = 0
    while a < len(text):
        z = a + CHARS
        if z < len(text):
            z = min((x for x in (text.find(" ", z), text.find("\n", z)) if x >= 0), default=len(text))
        yield text[a:z]
        a = z


def decode(pieces: Pieces, ids) -> str:
    """The text that ids stand for: the pieces' bytes without the one space in front."""
    t = pieces.text
    return b"".join([t[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


_samplers: dict[tuple, Sampler] = {}


def _sampler(proto: bytes, alpha: float) -> Sampler:
    key = (hash(proto), alpha)
    if key not in _samplers:
        p = Pieces(proto)
        if alpha != 1:
            p.log_weight = p.log_weight * alpha
        _samplers.clear()
        _samplers[key] = Sampler(p)
    return _samplers[key]


def encode_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", options: SamplingOptions = SamplingOptions(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, ids array<int>, lossless (whether decoding ids gave the text back)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(options.vocabulary))
    alpha = options.alpha
    slim = docs.select(*keep, F.col(text).alias("_text"), F.xxhash64(F.lit(options.seed), F.col(key).cast("string")).alias("_key"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.select(*keep)).schema) + ", ids array<int>, lossless boolean"

    def run(batches):
        s = _sampler(shared.value, alpha)
        bytes_of = np.array(s.pieces.text, object)
        for b in batches:
            size = b.num_rows
            raw = b.column("_text").to_pylist()
            keys = b.column("_key").to_numpy().astype(np.int64).view(np.uint64)
            a = 0
            while a < size:  # a part of the batch at a time bounds what is held
                z, held = a, 0
                while z < size and (z == a or held < 4 * CHARS):
                    held += len(raw[z] or "")
                    z += 1
                texts = raw[a:z]
                there = [i for i, t in enumerate(texts) if t is not None]
                ids, n = s.encode([texts[i] for i in there], keys[a:z][there])
                sizes = np.zeros(z - a, np.int64)
                sizes[there] = n
                cut = np.r_[0, np.cumsum(sizes)]
                same: list[bool | None] = [None] * (z - a)
                for i in there:
                    same[i] = b"".join(bytes_of[ids[cut[i] : cut[i + 1]]].tolist())[1:] == texts[i].encode()
                mask = pa.array([t is None for t in texts], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()), mask=mask)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(a, z - a) for k in keep), lists, pa.array(same, pa.bool_())], names=[*keep, "ids", "lossless"])
                a = z

    return slim.mapInArrow(released(run), schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_rows(docs).select("doc_id", "ids", F.size("ids").alias("n_pieces"), "lossless")
