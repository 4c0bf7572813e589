"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct 5-word shingles (A-Z folded; a shorter line is one token). A line
is removed if an earlier line, by (doc_id, text, place), has 100 * intersection >= similarity *
union with it. "Earlier" does not ask whether that line was itself removed, so the result depends
on no order of work.

1. A sketch of fixed size counts all tokens of the corpus; tokens are ordered by it, rare first.
2. Lines of equal token sets collapse to their first occurrence: the rest are later matches. Sets
   are told apart by 128 bits of two hashes. Tokens and sets are dealt to bins by their hashes, as packed numbers;
   a bin tells which tokens more than one set has, and which sets more than one line. Lines whose set is their own
   meet no others here.
3. First occurrences are joined on their prefix tokens (two lines that are similar enough share
   one of them), under length and positional bounds.
4. Each line is first compared with the earliest line of each of its tokens' lists; only lines
   that this leaves unmatched are compared with all earlier lines of the lists. So a large group
   of copies costs a comparison for each line and token, not one for each pair.
5. Candidates are confirmed on the lines' own words. The texts are read again, and of their lines only
   those leave a task that a Bloom filter of fixed size lets pass; an exact join follows. Tokens that only one
   set has are left out in the same way; those that the filter lets pass meet no other line. So the same plan runs
   at every size, and whole texts are shuffled once, to meet the numbers of the lines that they lose; if only these
   numbers are asked for, not at all.

Lines without words stay. Null texts stay null. Rows of equal doc_id and text count as one
document and lose the same lines; null ids come first. A document whose lines all go keeps its row
and has an empty text. Extra columns are kept. Texts may be of any length: their lines are read in
stretches of bounded size, one longer text alone. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64, packed, released, table, unpacked
from .shingles import exact_shingles, shingles, stretches, words

BUCKETS = 1 << 22  # of the sketch
CHUNK = 1 << 18  # buckets in a chunk
SHIFT = np.uint64(42)  # from a token to its bucket
SECOND = np.uint64(0x5851F42D4C957F2D)  # sets the second hash of words apart from the first
FILTER_BITS = 1 << 27  # of a Bloom filter: 16 MB
FILTER_PARTS = 16
PROBES = 3
BINS = 1 << 11  # of tokens and sets, by their first bits
HELD = 1 << 18  # of these that a task holds at a time
LINE_STRETCH = 1 << 21  # bytes of texts whose lines are held at a time


@dataclass(frozen=True)
class LineDedupOptions:
    similarity: int = 80  # per cent


def _tokens(data: np.ndarray, off: np.ndarray, twice: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(token, number of its line among those with words; text << 32 | line of each such line; if asked
    for, each token's second hash)."""
    w, text, line = words(data, off)
    place = text << 32 | line
    new = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    return *shingles(w, group), place[new], shingles(mix64(w ^ SECOND), group)[0] if twice else None


def _sketch(batches):
    counts = np.zeros(BUCKETS, np.int32)
    for b in batches:
        for _, _, data, off in stretches(b.column("text")):
            h, _, _, _ = _tokens(data, off)
            at, n = np.unique((h >> SHIFT).astype(np.int32), return_counts=True)
            counts[at] += n.astype(np.int32)
    yield from _chunks(counts.astype(np.int64))


def _chunks(counts: np.ndarray):
    z = zstandard.ZstdCompressor(1)
    for k in range(BUCKETS // CHUNK):
        part = counts[k * CHUNK : (k + 1) * CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z.compress(part.tobytes())], pa.binary())], names=["chunk", "counts"])


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    d = zstandard.ZstdDecompressor()
    for b in batches:
        for k, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(d.decompress(c), np.int64)
            sums[k] = sums[k] + part if k in sums else part
    z = zstandard.ZstdCompressor(1)
    for k, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z.compress(part.tobytes())], pa.binary())], names=["chunk", "counts"])


def token_sketch(docs: DataFrame) -> np.ndarray:
    """Counts of the corpus' tokens by hash bucket, as logarithmic 8-bit ranks; its size is fixed."""
    parts = docs.select("text").mapInArrow(released(_sketch), "chunk int, counts binary")
    got = parts.repartition(BUCKETS // CHUNK, "chunk").mapInArrow(_add_up, "chunk int, counts binary").toArrow()
    counts = np.zeros(BUCKETS, np.uint8)
    d = zstandard.ZstdDecompressor()
    for k, c in zip(got["chunk"].to_pylist(), got["counts"].to_pylist(), strict=True):
        exact = np.frombuffer(d.decompress(c), np.int64)
        counts[k * CHUNK : (k + 1) * CHUNK] = np.minimum(255, np.round(8 * np.log2(exact + 1)))
    return counts


def _lines(shared, similarity: int):
    def run(batches):
        for b in batches:
            for a, z, data, off in stretches(b.column("text"), LINE_STRETCH):
                h, line, every, other = _tokens(data, off, twice=True)
                if not len(h):
                    continue
                rank = shared.value[(h >> SHIFT).astype(np.int64)]
                key = line.astype(np.uint64) << np.uint64(40) | rank.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
                order = np.argsort(key)
                if len(every) >= 1 << 24 or ((key[order][1:] == key[order][:-1]) & (h[order][1:] != h[order][:-1])).any():
                    order = np.lexsort((h, rank, line))  # the short key doesn't tell some apart
                h, line, other = h[order], line[order], other[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])]
                h, line, other = h[new], line[new], other[new]
                first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                n = np.diff(np.r_[first, len(h)])
                sums = np.add.reduceat(h, first), np.add.reduceat(h * (h | np.uint64(1)), first)
                prefix = n - (similarity * n + 99) // 100 + 1
                at = np.repeat(first - (np.cumsum(prefix) - prefix), prefix) + np.arange(prefix.sum())
                cut = (8 * np.r_[0, np.cumsum(prefix)]).astype(np.int32)
                tokens = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cut), pa.py_buffer(h[at])])
                cls = mix64(sums[0] ^ mix64(sums[1] + n.astype(np.uint64)))
                check = mix64(np.add.reduceat(mix64(other), first))  # with cls it names the set by 128 bits
                who = pa.array((every >> 32) + a)
                yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), pa.array(check.view(np.int64)), b.column("doc_id").take(who), b.column("dkey").take(who), pa.array((every & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int32)), tokens], names=["cls", "check", "doc_id", "dkey", "line", "n", "tokens"])

    return run


def _confirm(similarity: int):
    def run(batches):
        for b in batches:
            last, sets = None, set()
            good = []
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
                if x != last:
                    last, sets = x, exact_shingles(x or "")
                other = exact_shingles(y or "")
                both = len(sets & other)
                good.append(100 * both >= similarity * (len(sets) + len(other) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([b.column("b").filter(pa.array(good, pa.bool_()))], names=["b"])

    return run


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned longs that are packed in a binary column without nulls, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint64, (off[-1] - off[0]) // 8, off[0]), np.diff(off) // 8


def _class_key(cls: np.ndarray) -> np.ndarray:
    """Sets the numbers of classes apart from tokens."""
    return mix64(cls.view(np.uint64) ^ SECOND)


def _ends(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with the least and the largest of what they come with."""
    order = np.argsort(key)
    key, of = key[order], of[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.minimum.reduceat(of, first), np.maximum.reduceat(of, first)


def _in_bins(held: list) -> pa.RecordBatch:
    key, lo, hi = _ends(*(np.concatenate(x) for x in zip(*held, strict=True)))
    times = 1 + (lo != hi)
    key, of = np.repeat(key, times), np.repeat(lo, times)
    of[np.cumsum(times) - 1] = hi
    cut = np.r_[np.searchsorted(key, np.arange(BINS, dtype=np.uint64) << np.uint64(65 - BINS.bit_length())), len(key)]
    own = np.flatnonzero(np.diff(cut))
    off = pa.py_buffer((16 * np.r_[cut[own], len(key)]).astype(np.int32))
    pairs = pa.Array.from_buffers(pa.binary(), len(own), [None, off, pa.py_buffer(np.stack([key, of], 1))])
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pairs], names=["bin", "pairs"])


def _dealt(batches):
    """(bin, pairs): each token with the class of its line, each class with its line."""
    held, n = [], 0
    for b in batches:
        token, size = _longs(b.column("tokens"))
        cls = b.column("cls").to_numpy().view(np.uint64)
        line = _line_key(b.column("dkey").to_numpy(), b.column("line").to_numpy())
        held.append((np.r_[token, _class_key(cls)], np.r_[np.repeat(cls, size), line]))
        n += len(held[-1][0])
        if n >= HELD:
            yield _in_bins(held)
            held, n = [], 0
    if n:
        yield _in_bins(held)


def _repeated(batches):
    """h: what comes with more than one; the rows of a bin come one after another, and whole bins are held."""

    def of(held):
        pairs = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
        key, lo, hi = _ends(pairs[:, 0], pairs[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(key[lo != hi].view(np.int64))], names=["h"])

    held, n, last = [], 0, None
    for b in batches:
        for k, blob in zip(b.column("bin").to_pylist(), b.column("pairs").to_pylist(), strict=True):
            if k != last and n >= 16 * HELD:
                yield of(held)
                held, n = [], 0
            held.append(blob)
            n, last = n + len(blob), k  # bytes, 16 a pair
    if n:
        yield of(held)


def _place(one: np.ndarray, two: np.ndarray, k: int) -> np.ndarray:
    return ((one + np.uint64(k) * two) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter_of(batches):
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for b in batches:
        one = mix64(b.column("h").to_numpy().view(np.uint64))
        two = mix64(one ^ SECOND) | np.uint64(1)
        for k in range(PROBES):
            at = _place(one, two, k)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    z = zstandard.ZstdCompressor(1)
    for k in range(FILTER_PARTS):
        part = bits[k * len(bits) // FILTER_PARTS : (k + 1) * len(bits) // FILTER_PARTS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z.compress(part.tobytes())], pa.binary())], names=["part", "bits"])


def _joined_filters(batches):
    d, z, held = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1), {}
    for b in batches:
        for k, blob in zip(b.column("part").to_pylist(), b.column("bits").to_pylist(), strict=True):
            part = np.frombuffer(d.decompress(blob), np.uint8)
            held[k] = held[k] | part if k in held else part
    for k, part in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z.compress(part.tobytes())], pa.binary())], names=["part", "bits"])


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column h (longs); of fixed size, so that it can be broadcast whatever the number of keys."""
    parts = keys.select("h").mapInArrow(released(_filter_of), "part int, bits binary")
    got = parts.repartition(FILTER_PARTS, "part").mapInArrow(_joined_filters, "part int, bits binary").toArrow()
    bits, d = np.zeros((FILTER_PARTS, FILTER_BITS // 8 // FILTER_PARTS), np.uint8), zstandard.ZstdDecompressor()
    for k, blob in zip(got["part"].to_pylist(), got["bits"].to_pylist(), strict=True):
        bits[k] = np.frombuffer(d.decompress(blob), np.uint8)
    return bits.ravel()


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether keys may be in the filter; those that are always may."""
    one = mix64(h)
    left, two = np.arange(len(h)), np.zeros(1, np.uint64)
    for k in range(PROBES):  # most are told by the first
        at = _place(one, two, k)
        own = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        left, one = left[own], one[own]
        two = two[own] if k else mix64(one ^ SECOND) | np.uint64(1)
    good = np.zeros(len(h), bool)
    good[left] = True
    return good


def _line_key(dkey: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(dkey.view(np.uint64) ^ mix64(line.astype(np.uint64) + np.uint64(1)))


def _line_keys(batches):
    for b in batches:
        h = _line_key(b.column("dkey").to_numpy(), b.column("line").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _wanted_lines(shared):
    def run(batches):
        bits = shared.value
        for b in batches:
            dkey = b.column("dkey").to_numpy()
            for a, _, data, off in stretches(b.column("text"), LINE_STRETCH):
                ends = np.flatnonzero(data == 10)
                text = np.r_[np.arange(len(off) - 1), np.searchsorted(off, ends, "right") - 1]
                starts = np.r_[off[:-1], ends + 1]  # a text's first line, and those after a line end in it
                order = np.lexsort((starts, text))
                text, starts = text[order], starts[order]
                line = np.arange(len(text)) - np.searchsorted(text, text)
                last = np.r_[text[1:] != text[:-1], True]
                stop = np.where(last, off[text + 1], np.r_[starts[1:], 0] - 1)
                own = np.flatnonzero(_maybe(bits, _line_key(dkey[a + text], line)))
                raw = [data[starts[i] : stop[i]].tobytes() for i in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(dkey[a + text[own]]), pa.array(line[own].astype(np.int32)), pa.array(raw, pa.binary()).cast(pa.string())], names=["dkey", "line", "text"])

    return run


def _line_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """at, text of the lines that wanted (at) names; only these, and few others, leave the task that reads their text."""
    wanted = materialize(wanted.select("at", F.col("at.dkey").alias("dkey"), F.col("at.line").alias("line")), "line-wanted")
    bits = key_filter(wanted.select("dkey", "line").mapInArrow(_line_keys, "h long"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    lines = docs.select("dkey", "text").mapInArrow(released(_wanted_lines(shared)), "dkey long, line int, text string")
    return materialize(lines.join(wanted, ["dkey", "line"]).select("at", "text").dropDuplicates(["at"]), "line-texts")


def _with_copies(shared):
    """The lines whose class may be that of other lines too."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_maybe(shared.value, _class_key(b.column("cls").to_numpy()))))

    return run


def _shared_tokens(shared, alone: bool):
    """The tokens that other classes may have too, a row each; alone: only of lines whose class no other line has."""

    def run(batches):
        bits = shared.value
        for b in batches:
            if alone:
                b = b.filter(pa.array(~_maybe(bits, _class_key(b.column("cls").to_numpy()))))
            if not b.num_rows:
                continue
            token, n = _longs(b.column("tokens"))
            own = np.flatnonzero(_maybe(bits, token))
            row = np.repeat(np.arange(len(n)), n)[own]
            pos = own - (np.cumsum(n) - n)[row]
            who = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(who) for c in ("cls", "check", "n", "doc_id", "dkey", "line")), pa.array(pos.astype(np.int32)), pa.array(token[own].view(np.int64))], names=["cls", "check", "n", "doc_id", "dkey", "line", "pos", "token"])

    return run


def _similar(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """The b of pairs that their lines' own words confirm."""
    a, b = (texts.select(F.col("at").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    full = pairs.join(a, "a").join(b, "b").select("b", "text_a", "text_b")
    kind = full.schema["b"].dataType.simpleString()
    return full.mapInArrow(released(_confirm(similarity)), f"b {kind}").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    return packed(docs, "doc_id", "text").withColumn("dkey", F.xxhash64(F.col("doc_id").cast("string"), "text"))


def later_matches(docs: DataFrame, options: LineDedupOptions = LineDedupOptions()) -> DataFrame:
    """dkey, removed (line numbers) of documents that lose lines; docs: doc_id, text, dkey."""
    spark, t = docs.sparkSession, options.similarity
    shared = spark.sparkContext.broadcast(token_sketch(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "dkey", "text").where(F.col("text").isNotNull())
    row = f"cls long, check long, doc_id {kind}, dkey long, line int, n int, tokens binary"
    lines = materialize(slim.mapInArrow(released(_lines(shared, t)), row), "lines")
    place = F.struct("doc_id", "dkey", "line", "cls", "check")  # orders the lines, and names their classes

    # tokens of more than one class and classes of more than one line
    dealt = lines.select("cls", "dkey", "line", "tokens").mapInArrow(released(_dealt), "bin int, pairs binary")
    bits = spark.sparkContext.broadcast(key_filter(dealt.repartition("bin").sortWithinPartitions("bin").mapInArrow(released(_repeated), "h long")))
    copied = materialize(lines.mapInArrow(released(_with_copies(bits)), row), "line-copies")
    firsts = copied.groupBy("cls", "check").agg(F.min(F.struct("doc_id", "dkey", "line", "n", "tokens")).alias("first"), F.count("*").alias("copies"))
    firsts = materialize(firsts.select("cls", "check", "first.*", "copies"), "line-firsts")

    # the tokens' lists, without their earliest lines
    post = f"cls long, check long, n int, doc_id {kind}, dkey long, line int, pos int, token long"
    posts = lines.mapInArrow(released(_shared_tokens(bits, True)), post).union(firsts.drop("copies").mapInArrow(released(_shared_tokens(bits, False)), post))
    posts = materialize(posts.select("token", place.alias("at"), "n", "pos"), "line-tokens")
    leads = posts.groupBy("token").agg(F.min(F.struct("at", "n", "pos")).alias("lead"))
    posts = materialize(posts.join(leads.hint("merge"), "token").where(F.col("at.cls") != F.col("lead.at.cls")), "line-lists")

    def within(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
        """Length bound, and overlap that the places of a shared token leave possible."""
        room = F.least(na - pa_, nb - pb)
        return (F.lit(100) * F.least(na, nb) >= F.lit(t) * F.greatest(na, nb)) & (F.lit(100 + t) * room >= F.lit(t) * (na + nb))

    star = posts.where(within(F.col("lead.n"), F.col("lead.pos"), F.col("n"), F.col("pos")))
    star = materialize(star.select(F.col("lead.at").alias("a"), F.col("at").alias("b")).distinct(), "line-star")
    ends_of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct()
    texts = _line_texts(ends_of(star), docs)
    matched = materialize(_similar(star, texts, t), "line-matched")
    left = posts.select("token", F.col("at").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    rest = posts.select("token", F.col("at").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")).join(matched, "b", "left_anti")
    pairs = left.join(rest, "token").where((F.col("a") < F.col("b")) & within(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"))).select("a", "b").distinct()
    pairs = materialize(pairs, "line-pairs")
    if pairs.limit(1).count():
        more = ends_of(pairs).join(texts.select("at"), "at", "left_anti")
        if more.limit(1).count():
            texts = texts.union(_line_texts(more, docs))
        matched = materialize(matched.union(_similar(pairs, texts, t)), "line-all-matched")

    hits = matched.select("b.cls", "b.check").distinct().withColumn("hit", F.lit(True))
    first = firsts.join(hits, ["cls", "check"], "left").where((F.col("copies") > 1) | F.col("hit"))
    first = materialize(first.select("cls", "check", place.alias("first"), F.coalesce("hit", F.lit(False)).alias("hit")), "line-groups")
    gone = copied.select("cls", "check", place.alias("at")).join(first.hint("merge"), ["cls", "check"]).where(F.col("hit") | (F.col("at") != F.col("first")))
    gone = gone.select("at.dkey", "at.line").union(matched.select("b.dkey", "b.line"))
    return gone.groupBy("dkey").agg(F.collect_set("line").alias("removed"))


def _without(lines: Column, removed: Column) -> Column:
    """The other lines as a text: the stretches before, between and after the removed ones, so that the work is in proportion to the lines."""

    def stretch(k: Column) -> Column:
        start = F.coalesce(F.get(removed, k - 1) + 2, F.lit(1))
        return F.slice(lines, start, F.coalesce(F.get(removed, k), F.size(lines)) - start + 1)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), stretch)), "\n")


def dedup_lines(docs: DataFrame, options: LineDedupOptions = LineDedupOptions()) -> DataFrame:
    """docs with n_lines, removed (sorted line numbers) and deduped (the text without them); these replace columns of their names."""
    keyed = _keyed(docs)
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    keyed = keyed.withColumn("n_lines", F.coalesce(n_lines, F.lit(0)))  # before the join, which texts then needn't go through for their count
    removed = materialize(later_matches(keyed.select("doc_id", "text", "dkey"), options), "lines-removed")
    out = keyed.join(removed.hint("merge"), "dkey", "left")  # at every size as at a large one
    out = out.withColumn("removed", F.coalesce(F.sort_array("removed"), F.array().cast("array<int>")))
    kept = F.get(F.transform(F.array(F.split("text", "\n", -1)), lambda lines: _without(lines, F.col("removed"))), 0)
    return unpacked(out.withColumn("deduped", F.when(F.size("removed") == 0, F.col("text")).otherwise(kept)), docs, ("doc_id", "text"), "n_lines", "removed", "deduped")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


OP6_SQL = """
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
lines AS (
  SELECT doc_id, i AS line, string_split_regex(trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM docs)),
sets AS (
  SELECT doc_id, line, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS s
  FROM lines WHERE len(w) > 0 AND NOT (len(w) = 1 AND w[1] = '')),
classes AS (SELECT s, min({'d': doc_id, 'l': line}) AS f, len(s) AS n, row_number() OVER () AS c FROM sets GROUP BY s),
tokens AS (SELECT c, f, n, unnest(s) AS t FROM classes),
hits AS (
  SELECT b.c FROM tokens a JOIN tokens b ON a.t = b.t AND a.f < b.f AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
gone AS (
  SELECT x.doc_id, x.line FROM sets x JOIN classes k ON x.s = k.s
  WHERE k.c IN (SELECT c FROM hits) OR {'d': x.doc_id, 'l': x.line} <> k.f)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(count(g.line) AS INTEGER) AS n_removed,
  coalesce(string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY g.line), '') AS removed_lines
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id GROUP BY d.doc_id, d.text
"""
