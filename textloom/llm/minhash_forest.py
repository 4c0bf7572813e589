"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each whole text becomes its set of 5-word shingles, a fingerprint of the set and a signature
   of 128 one-byte minima. Documents of equal sets collapse to one node.
2. The forest holds the signatures in several sorted orders, each starting at another place. A
   node's candidates are its neighbours in an order whose longest common prefix with it is at least
   ``depth`` bytes. A node looks back over ``reach`` rows, nearest first, so in a thin region it
   sees all that share the least depth, and in a dense one those of greater depth.
   Neighbours whose whole signatures make the similarity very unlikely (more than 5 standard
   deviations below it) are passed over, and so are those that share four bytes in an earlier order: that
   one compares them, or its region is wide. Rows are dealt by their order's first bytes, so a large region goes
   over many tasks; a region that a task's first or last rows cut counts as wide.
3. Candidates are confirmed on the full sets, best first: each node's best of the larger and of the
   smaller nodes, then the best between each two components, then all that still lie between
   components. Links inside a component would change nothing. All nodes of regions wider than ``reach``
   are then sorted once more and compared, over ``far_reach`` rows and by longer signatures, with
   neighbours of other components.
4. All nodes of regions that are wider even than that are joined on their full sets: a pair that is
   similar enough has a shingle in common among the rarest of both (prefix-filtered join).
5. Components of confirmed links come from alternating stars; the smallest doc_id of each names it.

A text without words, or none, has an empty set and is its own component. Rows of equal doc_id are
separate rows with the same id. A row of null doc_id names its component only if no other row of it
has an id. Texts of any length are taken whole. Ties are broken by doc_id. Extra columns, of any name,
are kept by the stage; an empty table gives no rows.

What can be missed: a pair at exactly the least similarity shares no four bytes at any of the 16
places with a chance of 8 in a million (at 0.9 4 in a hundred million), and lies below the five
deviations with one of 3 in ten million; both once more for the longer signatures of wide regions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, packed, released, small_enough, table, unpacked
from .components import component_trees, node_labels
from .shingles import stretches, text_sets

SIZE = 128  # bytes of a signature
LONG = 1024  # and of a longer one, for dense regions
ORDERS = 16  # sorted orders; one begins at every sixteenth of a signature
DEALT = 16  # bytes of a turned signature that deal its row to a task


@dataclass(frozen=True)
class ForestOptions:
    similarity: int = 85  # per cent
    depth: int = 4
    reach: int = 8
    far_reach: int = 512
    broadcast_ids: int = 200_000

    def least_equal(self, size: int) -> int:
        s = self.similarity / 100
        return int(size * s - 5 * (size * s * (1 - s)) ** 0.5)


def _parameters(size: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_401)
    return r.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, size, dtype=np.uint64)


def signature(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 2048):
        np.minimum(low, (np.multiply.outer(a, h[k : k + 2048]) + b[:, None]).min(1), out=low)
    return ((low >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)


def _sign(batches):
    a, b = _parameters(SIZE)
    for batch in batches:
        for lo, hi, data, off in stretches(batch.column("text")):
            h, cut = text_sets(data, off)
            n = np.diff(cut)
            fa, fb = (np.array([x[s:e].sum(dtype=np.uint64) for s, e in zip(cut[:-1], cut[1:], strict=True)], np.uint64) for x in (h, h * (h | np.uint64(1))))
            sig = [signature(h[s:e], a, b).tobytes() if e > s else None for s, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "dkey")), pa.array(n, pa.int64()), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), pa.array(sig, pa.binary())], names=["doc_id", "dkey", "n", "fa", "fb", "sig"])


def _long_signatures(batches):
    a, b = _parameters(LONG)
    for batch in batches:
        sig = [signature(np.asarray(s.values).view(np.uint64), a, b).tobytes() for s in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sig, pa.binary())], names=["node", "sig"])


def _neighbours(options: ForestOptions, reach: int, size: int):
    """Candidate pairs (a < b, equal bytes) of rows sorted by order and signature; (a, a, 0) marks each
    node of a region wider than reach, and of the first and last one, which may go on in other tasks.

    A pair comes from the first order alone whose region both nodes share: there it was compared, or both are marked.
    """
    least, depth, s = options.least_equal(size), options.depth, options.similarity
    later = np.arange(ORDERS)

    def run(batches):
        kept, start = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, size)
            tree, node, n, label = (batch.column(c).to_numpy() for c in ("tree", "node", "n", "label"))
            old = 0
            if kept is not None:
                old = len(kept[0])
                sig, tree, node, n, label = (np.concatenate([x, y]) for x, y in zip(kept, (sig, tree, node, n, label), strict=True))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            i = np.arange(old, len(node))
            for j in range(1, reach + 1):
                i = i[i >= j]
                i = i[(tree[i] == tree[i - j]) & (sig[i, :depth] == sig[i - j, :depth]).all(1)]
                if not len(i):
                    break
                near = i[(100 * np.minimum(n[i], n[i - j]) >= s * np.maximum(n[i], n[i - j])) & (label[i] != label[i - j])]
                if len(near):
                    same = sig[near] == sig[near - j]
                    equal = same.sum(1)
                    # the k-th stretch of a turned signature begins order (tree + k) modulo ORDERS
                    shared = same.reshape(len(near), ORDERS, -1)[:, :, :depth].all(2)
                    good = (equal >= least) & ~(shared & (later >= ORDERS - tree[near, None])).any(1)
                    near, equal = near[good], equal[good]
                    out.append((np.minimum(node[near], node[near - j]), np.maximum(node[near], node[near - j]), equal.astype(np.int32)))
            marked = np.zeros(len(node), bool)
            if len(i):
                for j in range(reach + 1):
                    marked[i - j] = True
            start = (tree[0], sig[0, :depth]) if start is None else start
            if tree[old] == start[0] and (sig[old, :depth] == start[1]).all():
                marked[old:] |= (tree[old:] == start[0]) & (sig[old:, :depth] == start[1]).all(1)
            if marked.any():
                out.append((node[marked], node[marked], np.zeros(marked.sum(), np.int32)))
            kept = tuple(x[-reach:] for x in (sig, tree, node, n, label))
            if out:
                a, b, e = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(e)], names=["a", "b", "equal"])
        if kept is not None:
            sig, tree, node = kept[:3]
            last = node[(tree == tree[-1]) & (sig[:, :depth] == sig[-1, :depth]).all(1)]
            yield pa.RecordBatch.from_arrays([pa.array(last), pa.array(last), pa.array(np.zeros(len(last), np.int32))], names=["a", "b", "equal"])

    return run


def _candidates(nodes: DataFrame, options: ForestOptions, reach: int, size: int = SIZE) -> DataFrame:
    """nodes: node, n, sig (of size bytes), label."""
    step = size // ORDERS
    turned = F.array(*(F.struct(F.lit(t).alias("tree"), F.concat(F.substring("sig", t * step + 1, size), F.substring("sig", 1, t * step)).alias("sig")) for t in range(ORDERS)))
    rows = nodes.select("node", "n", "label", F.explode(turned).alias("x")).select("node", "n", "label", "x.tree", "x.sig")
    # the driver gets samples of what rows are dealt by, so that is short; regions that it cuts are marked
    ordered = rows.repartitionByRange("tree", F.substring("sig", 1, DEALT), "node").sortWithinPartitions("tree", "sig", "node")
    found = ordered.mapInArrow(released(_neighbours(options, reach, size)), "a long, b long, equal int")
    return materialize(found.groupBy("a", "b").agg(F.max("equal").alias("equal")), "forest-pairs")


def _sets(batches):
    for b in batches:
        for lo, hi, data, off in stretches(b.column("text")):
            h, cut = text_sets(data, off)
            yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(h.view(np.int64)))], names=["node", "shingles"])


def _far(side: DataFrame) -> DataFrame:
    """A side of a join that is never sent to the driver to be broadcast, however small it turns out to be."""
    return side.hint("merge")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    full = pairs.select("a", "b").join(_far(one), "a").join(_far(two), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    checked = full.select(F.col("a").alias("u"), F.col("b").alias("v"), both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return checked.where(F.lit(100) * F.col("both") >= F.lit(similarity) * (F.col("sum") - F.col("both"))).select("u", "v")


BUCKETS = 18  # bits of a shingle that name its bucket in the table of frequencies


def _bucket_counts(batches):
    total = np.zeros(1 << BUCKETS, np.int64)
    for b in batches:
        h = b.column("shingles").flatten().to_numpy().view(np.uint64) >> np.uint64(64 - BUCKETS)
        total += np.bincount(h.astype(np.int64), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def _heads(shared, similarity: int):
    """node, n, label, at, token: of each set's shingles, rarest first, those one of which a similar set must share."""

    def run(batches):
        for b in batches:
            lists = b.column("shingles")
            h = lists.flatten().to_numpy().view(np.uint64)
            n = lists.value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, shared.value[(h >> np.uint64(64 - BUCKETS)).astype(np.int64)], row))
            first = np.cumsum(n) - n
            at = np.arange(len(h)) - first[row]
            good = at < (n - (similarity * n + 99) // 100 + 1)[row]
            who = pa.array(row[good])
            yield pa.RecordBatch.from_arrays([b.column("node").take(who), pa.array(n[row][good]), b.column("label").take(who), pa.array(at[good]), pa.array(h[order][good].view(np.int64))], names=["node", "n", "label", "at", "token"])

    return run


def _sharing(sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of other labels that can be similar enough; sets: node, label, shingles.

    Of n shingles, rarest first, and m >= n of the larger set, t (n + m) / (100 + t) at least are common; so one is
    among the first n - 2 t n / (100 + t) + 1 of the smaller set and the first m - t m / 100 + 1 of the larger.
    How rare a shingle is comes from counts of fixed size, of buckets; any order that all sets share would do.
    Shingles that only nodes of one label hold in front are left out, so a group of linked copies costs nothing.
    """
    t = similarity
    parts = sets.select("shingles").mapInArrow(released(_bucket_counts), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKETS, np.int64)
    counts[parts["bucket"].to_numpy()] = parts["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    heads = materialize(sets.mapInArrow(released(_heads(shared, t)), "node long, n long, label long, at long, token long"), "forest-heads")
    across = heads.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("token")
    entries = materialize(heads.join(_far(across), "token", "left_semi"), "forest-heads")
    one = entries.where(F.lit(100 + t) * (F.col("n") - F.col("at")) >= F.lit(2 * t) * F.col("n"))
    one, two = one.select("token", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "label", "at"))), entries.select("token", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "label", "at")))
    near = (F.col("label1") != F.col("label2")) & (F.struct("n1", "node1") < F.struct("n2", "node2")) & (F.lit(100) * F.col("n1") >= F.lit(t) * F.col("n2"))
    rest = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))  # as many can be common from the first common one on
    found = one.join(_far(two), "token").where(near & (F.lit(100 + t) * rest >= F.lit(t) * (F.col("n1") + F.col("n2"))))
    return found.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that lie between components, with la < lb the components' labels."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    out = pairs.join(_far(la), "a", "left").join(_far(lb), "b", "left").withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")})
    return out.where(F.col("la") != F.col("lb")).withColumns({"la": F.least("la", "lb"), "lb": F.greatest("la", "lb")})


def _set_table(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, options: ForestOptions) -> DataFrame:
    """node, shingles of the nodes that take part in pairs."""
    ends = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    wanted = ends.join(_far(nodes).select("node", F.col("dkey").alias("wkey"), F.col("doc_id").alias("wid")), "node")
    if small_enough(wanted, options.broadcast_ids):
        wanted = F.broadcast(wanted)
    texts = docs.where(F.col("text").isNotNull()).join(wanted, (F.col("dkey") == F.col("wkey")) & F.col("doc_id").eqNullSafe(F.col("wid")))
    return materialize(texts.select("node", "text").mapInArrow(released(_sets), "node long, shingles array<long>"), "forest-sets")


def near_duplicates(docs: DataFrame, options: ForestOptions = ForestOptions()) -> DataFrame:
    """doc_id, dkey, n_shingles, component_id, component for each row of docs (doc_id, text, dkey).

    component tells components apart where ids repeat; an empty set's is the row's dkey.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    t = options.similarity
    signed = materialize(docs.select("doc_id", "dkey", "text").mapInArrow(released(_sign), f"doc_id {kind}, dkey long, n long, fa long, fb long, sig binary"), "signed")
    classes = signed.where(F.col("n") > 0).groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("doc_id", "dkey", "sig"), F.struct("doc_id", "dkey")).alias("x"))
    # written once, so a node keeps its number
    nodes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "fa", "fb", "n", "first", "x.doc_id", "x.dkey", "x.sig"), "nodes")

    pairs = _candidates(nodes.select("node", "n", "sig", F.col("node").alias("label")), options, options.reach)
    wide, pairs = pairs.where(F.col("a") == F.col("b")).select(F.col("a").alias("node")), pairs.where(F.col("a") != F.col("b"))
    sets = _set_table(docs, nodes, pairs, options)

    over = pairs.groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b")).select("a", "b")
    under = pairs.groupBy("b").agg(F.max_by("a", F.struct("equal", "a")).alias("a")).select("a", "b")
    tried = materialize(over.union(under).distinct(), "forest-first")
    trees = component_trees(_confirmed(tried, sets, t))
    labels = node_labels(trees)

    open_pairs = materialize(_between(pairs.join(_far(tried), ["a", "b"], "left_anti"), labels), "forest-between")
    best = open_pairs.groupBy("la", "lb").agg(F.max_by(F.struct("a", "b"), F.struct("equal", "a", "b")).alias("x")).select("x.a", "x.b")
    tried = materialize(best, "forest-second")
    trees = component_trees(_confirmed(tried, sets, t), trees)
    labels = node_labels(trees)

    last = materialize(_between(open_pairs.select("a", "b").join(_far(tried), ["a", "b"], "left_anti"), labels).select("a", "b"), "forest-third")
    trees = component_trees(_confirmed(last, sets, t), trees)
    labels = node_labels(trees)

    if wide.limit(1).count():
        whole = _set_table(docs, nodes, wide.select(F.col("node").alias("a"), F.col("node").alias("b")), options)
        signs = whole.mapInArrow(released(_long_signatures), "node long, sig binary").dropDuplicates(["node"])
        more = nodes.select("node", "n").join(_far(signs), "node").join(_far(labels), "node", "left").select("node", "n", "sig", F.coalesce("label", "node").alias("label"))
        far = _candidates(more, options, options.far_reach, LONG)
        still, far = far.where(F.col("a") == F.col("b")).select(F.col("a").alias("node")), far.where(F.col("a") != F.col("b"))
        far = materialize(far.join(_far(pairs.select("a", "b")), ["a", "b"], "left_anti"), "forest-far")
        if far.limit(1).count():
            trees = component_trees(_confirmed(far, whole, t), trees)
            labels = node_labels(trees)
        if still.limit(1).count():
            dense = whole.dropDuplicates(["node"]).join(_far(still), "node").join(_far(labels), "node", "left").select("node", F.coalesce("label", "node").alias("label"), "shingles")
            dense = materialize(dense, "forest-dense")
            shared = materialize(_sharing(dense, t).join(_far(pairs.union(far).select("a", "b")), ["a", "b"], "left_anti"), "forest-shared")
            if shared.limit(1).count():
                trees = component_trees(_confirmed(shared, dense, t), trees)
                labels = node_labels(trees)

    named = nodes.join(_far(labels), "node", "left").select("fa", "fb", "n", "first", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(_far(least), "label").select("fa", "fb", "n", "component_id", F.col("label").alias("component"))
    out = signed.select("doc_id", "dkey", "n", "fa", "fb").join(_far(named), ["fa", "fb", "n"], "left")
    return out.select("doc_id", "dkey", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("component", "dkey").alias("component"))


def _keyed(docs: DataFrame) -> DataFrame:
    return packed(docs, "doc_id", "text").withColumn("dkey", F.xxhash64(F.col("doc_id").cast("string"), "text"))


def drop_near_duplicates(docs: DataFrame, options: ForestOptions = ForestOptions()) -> DataFrame:
    """The columns of docs, one row of each component: that of the smallest doc_id.

    Rows of null doc_id stay. Of rows that repeat both doc_id and text, one stays.
    """
    keyed = _keyed(docs)
    found = materialize(near_duplicates(keyed.select("doc_id", "dkey", "text"), options), "near-duplicates")
    own = found.where(F.col("doc_id") == F.col("component_id")).groupBy("component_id", "component").agg(F.min("dkey").alias("own"), F.count("*").alias("rows"))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id", "dkey")
    again = own.where(F.col("rows") > 1)
    if again.limit(1).count():  # an id is repeated
        gone = gone.union(found.where(F.col("doc_id") == F.col("component_id")).join(again, ["component_id", "component"]).where(F.col("dkey") != F.col("own")).select("doc_id", "dkey"))
        keyed = keyed.join(again.select(F.col("own").alias("dkey")), "dkey", "left_anti").unionByName(keyed.join(again.select(F.col("own").alias("dkey")), "dkey", "left_semi").dropDuplicates(["dkey"]))
    gone = gone.distinct()
    if small_enough(gone, options.broadcast_ids):
        gone = F.broadcast(gone)
    return unpacked(keyed.join(gone, ["doc_id", "dkey"], "left_anti"), docs, ("doc_id", "text"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _keyed(table(spark, sf_dir, "documents"))
    return near_duplicates(docs.select("doc_id", "text", "dkey")).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP4_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR (len(w) = 1 AND w[1] = '') THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""
