"""Importance resampling towards a target: hashed n-gram features, a dictionary of distinct strings.

1. Blocks of documents (and of target texts) list their distinct n-grams with counts. A string's place
   in the shuffle is its part of the dictionary. There all blocks' strings meet: each distinct string is
   counted over the whole corpus and the whole target, and hashed to its bucket once.
2. The counts are summed to buckets; a bucket's gain is the log ratio of its smoothed shares, in thousandths.
3. The dictionary hands each block's strings back as buckets beside the documents' feature counts, which
   came along and are written once. Joined with the gains (one for each bucket) they are summed for each
   block and part, then a block's sums meet its documents. A block is named by its documents' hashes; if a
   document's counts don't add up to its own number of features, the job fails.
4. Seeded Gumbel noise makes the highest scores a draw without replacement in proportion to exp(weight / 1000).

Words that many documents have would make a few strings' lists of documents long. So ``head`` frequent
strings of a sample are told to all tasks. They are counted and hashed in the same way, but by number, and
their gains are added where the documents are. Which strings these are changes no result.

Null texts have no words. Rows of equal doc_id and text get equal weights, and are drawn next to each
other; null ids come first and their noise is that of the empty id. Without features the weight is 0. Texts
are read whole; a very long one is a block of its own. An empty table gives no rows; an empty target has all
counts 0. Ties in score go to the smaller doc_id. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, buffers, drop_tables, materialize, mix64, released, table
from .shingles import stretches

BLOCK = 1 << 22  # bytes of texts that make a block
PART_BYTES = 1 << 24  # of texts for each part of the dictionary
MIN_PARTS = 16
HEAD_GROUP = 4096  # strings of the head that are counted together
FIRST_BLOCK = -(1 << 40)  # parts from here on down hold blocks' documents


@dataclass(frozen=True)
class ResamplingOptions:
    ngrams: int = 2
    buckets: int = 10_000  # 65536 at most
    least_words: int = 20
    percent: int = 25
    seed: int = 7
    head: int = 100_000
    head_rows: int = 5_000  # documents of the sample that the head is taken from, about


_word = np.zeros(256, bool)
_word[48:58] = _word[65:91] = _word[97:123] = _word[128:] = True
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


def strings(lengths: np.ndarray, data: np.ndarray | bytes) -> pa.LargeStringArray:
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(off), pa.py_buffer(data))


def features(data: np.ndarray, off: np.ndarray, ngrams: int) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """(all n-grams, the text of each, words of each text) of the texts data[off[i]:off[i + 1]]."""
    texts = len(off) - 1
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(texts, np.int64)
    char = _word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.r_[False, char[:-1]]
    start = np.flatnonzero(char & (~before | edge[:-1]))
    end = np.flatnonzero(np.r_[before & (~char | edge[:-1]), char[-1]])
    words = strings(end - start, _fold[data[char]])
    text = np.searchsorted(off, start, "right") - 1
    grams, of, run, at = [words], [text], words, np.arange(len(words))
    for k in range(1, ngrams):
        go = at + k < len(words)
        go[go] = text[at[go]] == text[at[go] + k]
        run = pc.binary_join_element_wise(run.filter(pa.array(go)), words.take(pa.array(at[go] + k)), pa.scalar(" ", pa.large_string()))
        at = at[go]
        grams.append(run)
        of.append(text[at])
    return pa.concat_arrays(grams), np.concatenate(of), np.bincount(text, minlength=texts)


def _loads(s: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first 8 bytes, last 8 bytes) of each string, as numbers that sort like the bytes."""
    data, off = buffers(s)
    n = np.diff(off)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    every = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    word = lambda at: np.ascontiguousarray(every[at]).view(">u8").ravel().astype(np.uint64)
    cut = ((8 - np.minimum(n, 8)) * 8).astype(np.uint64)
    keep = np.where(n > 0, ~np.uint64(0) << np.minimum(cut, np.uint64(63)), np.uint64(0))
    return n, word(off[:-1]) & keep, word(off[1:] - np.minimum(n, 8)) & keep


def _part(n: np.ndarray, first: np.ndarray, last: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix64(mix64(first) + last * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
    return (h % np.uint64(parts)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: tuple[type, int]) -> Iterator[np.ndarray]:
    raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
    for kind, n in kinds:
        yield np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize


def pack_strings(data: np.ndarray, off: np.ndarray, first: np.ndarray) -> bytes:
    """Strings that are sorted by their first 8 bytes: how many of these each shares with the one before, and the rest.

    No string holds a line end, so line ends part them.
    """
    n = np.diff(off)
    apart = first[1:] ^ first[:-1]
    same = np.zeros(len(n), np.int64)
    for k in range(1, 9):
        same[1:] += apart < np.uint64(1 << (64 - 8 * k))
    same[1:] = np.minimum(same[1:], np.minimum(n[1:], n[:-1]))
    rest = n - same
    ends = np.cumsum(rest + 1) - 1
    out = np.full(int((rest + 1).sum()), 10, np.uint8)
    keep = np.arange(len(data)) - np.repeat(off[:-1], n) >= np.repeat(same, n)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = data[keep]
    return _pack(same.astype(np.uint8), out)


def unpack_strings(blob: bytes, count: int) -> pa.LargeStringArray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    same, out = raw[:count].astype(np.int64), raw[count:]
    ends = np.flatnonzero(out == 10)
    rest = np.diff(np.r_[-1, ends]) - 1
    n = same + rest
    off = np.r_[0, np.cumsum(n)]
    data = np.zeros(int(off[-1]), np.uint8)
    place = np.arange(len(data)) - np.repeat(off[:-1], n)
    data[place >= np.repeat(same, n)] = out[out != 10]
    row = np.arange(count)
    for k in range(int(same.max(initial=0))):  # the last string before that has its own byte there
        origin = np.maximum.accumulate(np.where((same <= k) & (n > k), row, 0))
        want = same > k
        data[off[:-1][want] + k] = data[off[:-1][origin[want]] + k]
    return strings(n, data)


def _counted(text: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, text, count) of distinct pairs, by code."""
    pair, n = np.unique(code.astype(np.int64) * size + text, return_counts=True)
    return pair // size, pair % size, n


def _blocks(parts: int, ngrams: int, shared):
    """Rows for the dictionary's parts: strings with the documents that have them, numbers of the head, blocks' documents."""

    def run(batches):
        head = pa.array(shared.value, pa.large_string())
        for batch in batches:
            schema = _schema(batch.column("doc_id").type)
            for target in (False, True):
                b = batch.filter(pc.equal(batch.column("target"), target))
                for a, z, data, off in stretches(b.column("text"), BLOCK):
                    grams, text, _ = features(data, off, ngrams)
                    if not len(grams):
                        continue
                    coded = grams.dictionary_encode()
                    names = coded.dictionary
                    code, owner, n = _counted(text, coded.indices.to_numpy(), z - a)
                    known = pc.index_in(names, head) if len(head) else pa.nulls(len(names), pa.int32())
                    is_head = known.is_valid().to_numpy(zero_copy_only=False)
                    rows = []
                    if is_head.any():
                        total = np.bincount(code, weights=n, minlength=len(names)).astype(np.int64)
                        rows += _head_rows(known.drop_null().to_numpy(), total[is_head], target)
                    hashes = b.column("hash").slice(a, z - a).to_numpy()
                    block = xxhash.xxh3_128_digest(hashes.tobytes())
                    if not target:
                        rows.append({"part": FIRST_BLOCK - int.from_bytes(block[:2], "big"), "target": False, "block": block, "ids": b.column("doc_id").slice(a, z - a).to_pylist(), "hashes": hashes})
                    rows += _part_rows(names, code, owner, n, ~is_head, parts, target, block)
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("target", pa.bool_()), ("block", pa.binary()), ("ids", pa.list_(kind)), ("hashes", pa.list_(pa.int64())), ("n", pa.int64()), ("size", pa.int64()), ("names", pa.binary()), ("lists", pa.binary()), ("numbers", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _spark(kind: str) -> str:
    return f"part long, target boolean, block binary, ids array<{kind}>, hashes array<long>, n long, size long, names binary, lists binary, numbers array<int>, counts array<long>"


def _head_rows(number: np.ndarray, total: np.ndarray, target: bool) -> list[dict]:
    group = number // HEAD_GROUP
    return [{"part": -1 - int(g), "target": target, "numbers": number[group == g], "counts": total[group == g]} for g in np.unique(group)]


def _part_rows(names, code, owner, n, tail: np.ndarray, parts: int, target: bool, block: bytes) -> list[dict]:
    length, first, last = _loads(names)
    part = _part(length, first, last, parts)
    wanted = np.flatnonzero(tail)
    wanted = wanted[np.argsort(first[wanted])]  # like strings beside each other
    wanted = wanted[np.argsort(part[wanted].astype(np.uint16 if parts <= 65536 else np.int64), kind="stable")]
    place = np.full(len(names), -1, np.int64)
    place[wanted] = np.arange(len(wanted))
    at = place[code]
    here = at >= 0
    at, owner, n = at[here], owner[here], n[here].astype(np.uint32)
    order = np.argsort(at, kind="stable")
    owner, n = owner[order], n[order]
    high, low = (owner >> 8).astype(np.uint8), (owner & 255).astype(np.uint8)
    lists = np.bincount(at, minlength=len(wanted)).astype(np.uint32)
    ends = np.r_[0, np.cumsum(lists)]
    cuts = np.flatnonzero(np.r_[True, np.diff(part[wanted]) != 0, True]) if len(wanted) else np.zeros(1, np.int64)
    (data, off), rows = buffers(names.take(pa.array(wanted))), []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        x = slice(ends[a], ends[z])
        packed = pack_strings(data[off[a] : off[z]], off[a : z + 1] - off[a], first[wanted[a:z]])
        rows.append({"part": int(part[wanted[a]]), "target": target, "block": block, "n": z - a, "size": ends[z] - ends[a], "names": packed, "lists": _pack(lists[a:z], high[x], low[x], n[x])})
    return rows


def _merged(options: ResamplingOptions, shared):
    """Parts of the dictionary, one after another: counts by bucket, and blocks with buckets in place of strings."""

    def run(batches):
        held: list[dict] = []
        for b in batches:
            schema = _out_schema(b.column("ids").type.value_type)
            for k in range(len(b)):
                row = b.slice(k, 1).to_pylist()[0]
                if held and held[0]["part"] != row["part"]:
                    yield from close(held, schema)
                    held = []
                held.append(row)
        if held:
            yield from close(held, schema)

    def close(rows, schema):
        part = rows[0]["part"]
        make = string_part if part >= 0 else documents if part <= FIRST_BLOCK else head_part
        for r in make(rows):  # a block at a time
            yield pa.RecordBatch.from_pylist([r], schema=schema)

    def documents(rows):
        for r in rows:
            yield {c: r[c] for c in ("block", "ids", "hashes")}

    def head_part(rows):
        counts, base = np.zeros((2, HEAD_GROUP), np.int64), (-1 - rows[0]["part"]) * HEAD_GROUP
        for r in rows:
            counts[int(r["target"]), np.array(r["numbers"]) - base] += r["counts"]
        has = np.flatnonzero(counts.sum(0))
        bucket = np.array([zlib.crc32(shared.value[base + k].encode()) % options.buckets for k in has], np.int64)
        by = [np.bincount(bucket, weights=c[has], minlength=options.buckets).astype(np.int64) for c in counts]
        some = np.flatnonzero(by[0] + by[1])
        yield {"bucket": some.astype(np.int32), "raw": by[0][some], "goal": by[1][some], "numbers": (base + has).astype(np.int32), "number_buckets": bucket.astype(np.int32)}

    def string_part(rows):
        coded = pa.chunked_array([unpack_strings(r.pop("names"), r["n"]) for r in rows]).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        (data, off), step, bucket = buffers(coded.dictionary), 1 << 16, []
        del coded
        for k in range(0, len(off) - 1, step):  # each distinct string is hashed here, and nowhere else
            ends = off[k : k + step + 1].tolist()
            raw = data[ends[0] : ends[-1]].tobytes()
            bucket.append(np.array([zlib.crc32(raw[x - ends[0] : y - ends[0]]) % options.buckets for x, y in zip(ends, ends[1:], strict=False)], np.uint16))
        bucket, at = np.concatenate(bucket)[codes], 0
        del codes, data, off
        total, blocks = np.zeros((2, options.buckets), np.int64), []
        for r in rows:
            per, high, low, n = _unpack(r.pop("lists"), (np.uint32, r["n"]), (np.uint8, r["size"]), (np.uint8, r["size"]), (np.uint32, r["size"]))
            of = np.repeat(bucket[at : at + r["n"]], per)
            at += r["n"]
            by = np.bincount(of, weights=n, minlength=options.buckets).astype(np.int64)
            total[int(r["target"])] += by
            if not r["target"]:
                order = np.argsort(of, kind="stable")
                blob = _pack(np.bincount(of, minlength=options.buckets).astype(np.uint32), high[order], low[order], n[order])
                blocks.append({"block": r["block"], "size": r["size"], "lists": blob})
        has = np.flatnonzero(total.sum(0))
        yield {"bucket": has.astype(np.int32), "raw": total[0][has], "goal": total[1][has]}
        yield from blocks

    return run


def _out_schema(kind: pa.DataType) -> pa.Schema:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    return pa.schema([("bucket", ints), ("raw", longs), ("goal", longs), ("numbers", ints), ("number_buckets", ints), ("block", pa.binary()), ("ids", pa.list_(kind)), ("hashes", longs), ("size", pa.int64()), ("lists", pa.binary())])


def _out_spark(kind: str) -> str:
    return f"bucket array<int>, raw array<long>, goal array<long>, numbers array<int>, number_buckets array<int>, block binary, ids array<{kind}>, hashes array<long>, size long, lists binary"


def _tail_sums(options: ResamplingOptions, shared):
    """What a block's documents have from one part: sums of gains and of counts."""

    def run(batches):
        gain = shared.value
        for b in batches:
            sums = []
            for n, blob in zip(b.column("size").to_pylist(), b.column("lists"), strict=True):
                per, high, low, n = _unpack(blob.as_py(), (np.uint32, options.buckets), (np.uint8, n), (np.uint8, n), (np.uint32, n))
                mine = high.astype(np.int64) << 8 | low
                w = np.bincount(mine, weights=np.repeat(gain, per) * n).astype(np.int64)  # whole, and far below 2^53
                c = np.bincount(mine, weights=n).astype(np.int64)
                has = np.flatnonzero(c)
                sums.append(_pack(has.astype(np.uint16), w[has], c[has].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array([None] * len(b), b.column("ids").type), pa.array([None] * len(b), pa.list_(pa.int64())), pa.array(sums, pa.binary())], names=["block", "ids", "hashes", "sums"])

    return run


def _documents(batches):
    """Blocks, one after another: their documents with what all parts gave them."""
    held: list[tuple] = []

    def close(kind):
        docs = [x for x in held if x[1] is not None]
        size = len(docs[0][2])
        w, c = np.zeros((2, size), np.int64)
        for *_, blob in held:
            if blob is not None:
                raw = zstandard.ZstdDecompressor().decompress(blob)
                at, x, n = (np.frombuffer(raw, k, len(raw) // 14, o * (len(raw) // 14)) for k, o in ((np.uint16, 0), (np.int64, 2), (np.uint32, 10)))
                w[at] += x
                c[at] += n
        # the same documents in the same order more than once have added up
        return pa.RecordBatch.from_arrays([pa.array(docs[0][1], kind), pa.array(docs[0][2], pa.int64()), pa.array(w // len(docs)), pa.array(c // len(docs))], names=["doc_id", "hash", "w", "n"])

    kind = None
    for b in batches:
        kind = b.column("ids").type.value_type
        for k in range(len(b)):
            row = tuple(b.column(c)[k].as_py() for c in ("block", "ids", "hashes", "sums"))
            if held and held[0][0] != row[0]:
                yield close(kind)
                held = []
            held.append(row)
    if held:
        yield close(kind)


def _own_sums(options: ResamplingOptions, shared):
    """Each document's words, features, features that are not in the head, and the sum of the head's gains."""

    def run(batches):
        names, gain = shared.value
        head, gain = pa.array(names, pa.large_string()), np.array([*gain, 0], np.int64)
        for b in batches:
            found = [np.zeros(0, np.int64)] * 4
            for a, z, data, off in stretches(b.column("text"), BLOCK):
                grams, text, words = features(data, off, options.ngrams)
                number = pc.index_in(grams, head).fill_null(len(head)).to_numpy() if len(head) else np.zeros(len(grams), np.int64)
                summed = lambda x: np.bincount(text, weights=x, minlength=z - a).astype(np.int64)  # noqa: E731, B023  whole, and far below 2^53
                new = (words, summed(None), summed(number == len(head)), summed(gain[number]))
                found = [np.concatenate(x) for x in zip(found, new, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), *map(pa.array, found)], names=["doc_id", "hash", "n_words", "n_features", "n_tail", "w"])

    return run


def _feature_rows(ngrams: int):
    def run(batches):
        for b in batches:
            for _, _, data, off in stretches(b.column("text"), BLOCK):
                counts = features(data, off, ngrams)[0].value_counts()
                yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["feature", "n"])

    return run


def frequent(docs: DataFrame, rows: int, options: ResamplingOptions) -> list[str]:
    """The most frequent features, of 64 characters at most, of a sample of about options.head_rows documents."""
    some = docs.where(F.pmod("hash", F.lit(rows // options.head_rows + 1)) == 0)
    counts = some.select("text").mapInArrow(_feature_rows(options.ngrams), "feature string, n long").where(F.length("feature") <= 64).groupBy("feature").agg(F.sum("n").alias("n"))
    return [r.feature for r in counts.where("n > 1").orderBy(F.desc("n"), "feature").limit(options.head).collect()]


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares."""
    k = len(raw)
    s, t = float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + k) / ((x + 1.0) * (t + k)))) for x, y in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, target: DataFrame, options: ResamplingOptions = ResamplingOptions()) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs (doc_id, text) against target (text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("target")).withColumn("hash", F.xxhash64("doc_id", "text"))
    other = target.select(F.lit(None).cast(kind).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("target"), F.lit(0).cast("long").alias("hash"))
    every = own.union(other)
    rows, size = own.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    head = frequent(own, rows, options)
    names = spark.sparkContext.broadcast(head)
    parts = max(MIN_PARTS, (size or 0) // PART_BYTES)
    listed = every.mapInArrow(released(_blocks(parts, options.ngrams, names)), _spark(kind))
    dealt = listed.repartition(parts, "part").sortWithinPartitions("part")
    merged = materialize(dealt.mapInArrow(released(_merged(options, names)), _out_spark(kind)), "feature-buckets")

    sums = merged.where("bucket is not null").select(F.explode(F.arrays_zip("bucket", "raw", "goal")).alias("x")).groupBy("x.bucket").agg(F.sum("x.raw").alias("raw"), F.sum("x.goal").alias("goal")).collect()  # a row a bucket
    both = np.zeros((2, options.buckets), np.int64)
    for r in sums:
        both[:, r.bucket] = r.raw, r.goal
    gain = gains(*both)
    of_head = np.zeros(len(head), np.int64)
    for r in merged.where("numbers is not null").select("numbers", "number_buckets").collect():  # a row for each 4096 of the head
        of_head[r.numbers] = gain[r.number_buckets]

    shape = f"block binary, ids array<{kind}>, hashes array<long>, sums binary"
    given = merged.where("lists is not null").select("block", "ids", "size", "lists").mapInArrow(released(_tail_sums(options, spark.sparkContext.broadcast(gain))), shape)
    given = given.union(merged.where("hashes is not null").select("block", "ids", "hashes", F.lit(None).cast("binary").alias("sums")))
    tail = given.repartition("block").sortWithinPartitions("block").mapInArrow(_documents, f"doc_id {kind}, hash long, w long, n long")
    tail = tail.groupBy("doc_id", "hash").agg(F.max("w").alias("tail_w"), F.max("n").alias("tail_n"))  # equal rows have equal sums
    tail = materialize(tail.withColumnsRenamed({"doc_id": "tail_id", "hash": "tail_hash"}), "tail-sums")  # so that a join on a row that is often repeated can be split
    slim = own.select("doc_id", "text", "hash").mapInArrow(released(_own_sums(options, spark.sparkContext.broadcast((head, of_head)))), f"doc_id {kind}, hash long, n_words long, n_features long, n_tail long, w long")
    joined = slim.join(tail, (F.col("hash") == F.col("tail_hash")) & F.col("doc_id").eqNullSafe(F.col("tail_id")), "left")
    whole = F.coalesce("tail_n", F.lit(0)) == F.col("n_tail")
    total = F.when(whole, F.col("w") + F.coalesce("tail_w", F.lit(0))).otherwise(F.raise_error("a document's features were counted in blocks that changed; run again").cast("long"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0))
    out = materialize(joined.withColumn("total", total).select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight")), "weights")
    drop_tables(merged)
    return out


def noise(doc_id: Column, seed: int) -> Column:
    """Seeded Gumbel noise of an id, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighted: DataFrame, options: ResamplingOptions = ResamplingOptions()) -> DataFrame:
    """weighted (doc_id, n_words, n_features, weight) with score and rank; rank is null for what isn't drawn.

    Rows are ranked in ranges of the score, which are written; the ranges before one add their counts.
    """
    spark = weighted.sparkSession
    scored = weighted.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), options.seed)).cast("long"))
    may = scored.where(F.col("n_words") >= options.least_words)
    order = (F.desc("score"), F.asc("doc_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(may.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "score-ranges")
    counts = dict(ranged.groupBy("range").count().collect())  # a row a range
    wanted = options.percent * sum(counts.values()) // 100
    before, starts = 0, [0] * (max(counts, default=0) + 1)
    for k in sorted(counts):
        starts[k], before = before, before + counts[k]
    start = F.element_at(F.lit(np.array(starts, np.int64)).cast("array<long>"), F.col("range") + 1)
    rank = (start + F.row_number().over(Window.partitionBy("range").orderBy(*order))).cast("long")
    ranked = ranged.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).drop("range")
    others = scored.where(F.col("n_words") < options.least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return draw(weights(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


_FOLDED = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP12_SQL = f"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM (SELECT {_FOLDED} AS w FROM benchmark)),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
b AS (SELECT f, xor(4294967295, list_reduce([4294967295]::BIGINT[] || list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
  lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]))) % 10000 AS b FROM h, crc),
s AS (SELECT b, count(*) AS s FROM df JOIN b USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM bf JOIN b USING (f) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM df) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bf) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT b FROM b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
w AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN b USING (f) JOIN g USING (b) GROUP BY r),
x AS (SELECT doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * (SELECT count(*) FROM y WHERE n_words >= 20) // 100 THEN k END AS rank FROM z
"""
