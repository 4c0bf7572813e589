from itertools import combinations

import pytest
from conftest_llm import edited, prose
from pyspark.sql import functions as F

from textloom.llm import minhash_forest as M
from textloom.llm.components import component_trees, node_labels
from textloom.llm.shingles import exact_shingles

DOCS = "doc_id long, text string"


def fold(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows) -> dict:
    """doc_id: (set size, component) by comparing all pairs; ids must differ."""
    sets = {i: exact_shingles(t or "") for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def run(spark, rows, options=M.ForestOptions()) -> dict:
    docs = M._keyed(spark.createDataFrame(rows, DOCS))
    return {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs.select("doc_id", "text", "dkey"), options).collect()}


def test_against_all_pairs(spark):
    rows, i = [], 100
    for seed in range(12):
        base = prose(seed, 60 + 40 * seed)
        for share in (0, 0, 0.005, 0.01, 0.02, 0.04, 0.1):
            rows.append((i, edited(base, share, i)))
            i -= 1 if seed % 2 else -3
    rows = [(k + 1000, t) for k, (_, t) in enumerate(rows)]
    assert run(spark, rows) == plain(rows)


def test_chains_and_short_texts(spark):
    base = prose(1, 200).split()
    rows = [(i, " ".join(base[2 * i : 2 * i + 150])) for i in range(20)]
    rows += [(50, "Three words only"), (51, "three WORDS  only"), (52, "three words"), (53, ""), (54, None), (55, " \n"), (56, "the same five words here"), (57, "the same five words here")]
    got = run(spark, rows)
    assert got == plain(rows)
    assert got[19][1] == 0 and got[51] == (1, 50) and got[53] == (0, 53) and got[54] == (0, 54)


def test_a_large_group_of_near_copies(spark):
    base = prose(5, 300)
    rows = [(i, edited(base, 0.004, i)) for i in range(400)] + [(i + 1000, base) for i in range(200)] + [(i + 5000, prose(i + 99, 100)) for i in range(50)]
    assert run(spark, rows, M.ForestOptions(reach=2, far_reach=16)) == plain(rows)


def test_links_inside_a_wide_region_of_different_texts(spark):
    """All pairs share a passage (0.81); each text has one partner that it shares more with (0.86)."""
    base, rows = prose(8, 180), []
    for i in range(150):
        own = prose(1000 + i // 2, 5) if i < 100 else ""
        rows.append((i, f"{base} {own} {prose(3000 + i, 15 if own else 20)}"))
    got = run(spark, rows, M.ForestOptions(reach=2, far_reach=4))
    assert got == plain(rows)
    assert [got[i][1] for i in (0, 1, 98, 99, 100, 101)] == [0, 0, 98, 98, 100, 101]


def test_all_nodes_of_a_wide_region_are_marked():
    import numpy as np
    import pyarrow as pa

    o = M.ForestOptions(reach=3)
    sig = [bytes([1] * 4 + [k] * (M.SIZE - 4)) for k in range(10)] + [bytes([2] * M.SIZE)]
    b = pa.RecordBatch.from_arrays([pa.array(np.zeros(11, np.int32)), pa.array(np.arange(11)), pa.array(np.full(11, 9)), pa.array(np.arange(11)), pa.array(sig)], names=["tree", "node", "n", "label", "sig"])
    for batches in ([b], [b.slice(0, 5), b.slice(5)]):
        got = {(r["a"], r["b"]) for out in M._neighbours(o, 3, M.SIZE)(batches) for r in out.to_pylist()}
        assert {a for a, b in got if a == b} == set(range(11))  # the last row's region may go on in another task
    sig = [bytes([k // 2] * M.SIZE) for k in range(8)]
    b = pa.RecordBatch.from_arrays([pa.array(np.zeros(8, np.int32)), pa.array(np.arange(8)), pa.array(np.full(8, 9)), pa.array(np.arange(8)), pa.array(sig)], names=["tree", "node", "n", "label", "sig"])
    got = {(r["a"], r["b"]) for out in M._neighbours(o, 3, M.SIZE)([b.slice(0, 1), b.slice(1)]) for r in out.to_pylist()}
    assert {a for a, b in got if a == b} == {0, 1, 6, 7}


def turned_rows(sigs):
    """The rows of all orders, as they reach a single task."""
    import pyarrow as pa

    step = len(sigs[0]) // M.ORDERS
    rows = sorted((t, s[t * step :] + s[: t * step], i) for t in range(M.ORDERS) for i, s in enumerate(sigs))
    tree, sig, node = zip(*rows, strict=True)
    n = [9] * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(node), pa.array(n), pa.array(node), pa.array(sig, pa.binary())], names=["tree", "node", "n", "label", "sig"])


@pytest.mark.parametrize("size", [M.SIZE, M.LONG])
def test_a_pair_comes_from_one_order(size):
    import random

    r, sigs, o = random.Random(2), [], M.ForestOptions()
    for g in range(12):
        base = bytes(r.randrange(256) for _ in range(size))
        sigs += [bytes(r.randrange(256) if r.random() < 0.04 else c for c in base) for _ in range(6)]
    rows = turned_rows(sigs)
    got = [(x["a"], x["b"]) for k in (len(rows), 40) for out in M._neighbours(o, 8, size)([rows.slice(i, k) for i in range(0, len(rows), k)]) for x in out.to_pylist() if x["a"] != x["b"]]
    want = {(a, b) for a, b in combinations(range(len(sigs)), 2) if a // 6 == b // 6}
    assert set(got) == want and len(got) == 2 * len(want)


def test_the_driver_gets_short_keys(spark):
    """Rows are dealt to tasks by a few bytes of a signature, not by all 1024."""
    nodes = spark.createDataFrame([(i, 9, bytearray(M.LONG), i) for i in range(3)], "node long, n long, sig binary, label long")
    asked = []
    deal = type(nodes).repartitionByRange
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(nodes), "repartitionByRange", lambda self, *by: asked.append(self.select(*by)) or deal(self, *by))
        M._candidates(nodes, M.ForestOptions(), 512, M.LONG)
    keys = asked[0].collect()
    assert len(keys) == 3 * M.ORDERS and all(len(x) <= 32 for k in keys for x in k if isinstance(x, bytes | bytearray))


@pytest.mark.parametrize("task_edges", [1 << 20, 7])
def test_components(spark, task_edges):
    import random

    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 501 + i) for i in range(80)] + [(9, 9)]
    parent = list(range(600))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    half = component_trees(frame(edges[::2]), None, task_edges)
    got = node_labels(component_trees(frame(edges[1::2]), half, task_edges)).collect()
    assert sorted((x.node, x.label) for x in got) == sorted({(i, root(i)) for a, b in edges if a != b for i in (a, b)})


def test_sharing_loses_no_similar_pair(spark):
    import random

    r, sets = random.Random(4), []
    for i in range(60):
        core = list(range(r.choice((80, 88, 95))))
        sets.append((i, i, core + [1000 * (i // 2) + 5000 + k for k in range(r.choice((4, 9)))] + [10**6 + 100 * i + k for k in range(r.randrange(9))]))
    frame = spark.createDataFrame(sets, "node long, label long, shingles array<long>")
    got = {(x.a, x.b) for x in M._sharing(frame, 85).collect()}
    want = {(a, b) for (a, _, x), (b, _, y) in combinations(sets, 2) if 100 * len(set(x) & set(y)) >= 85 * len(set(x) | set(y))}
    assert want and want <= got


def test_ten_thousand_documents_of_one_template(spark):
    """All alike to 0.7 or so; of each twentieth and the next one, 0.87 or more are equal."""
    base, rows = prose(11, 84).split(), []
    for i in range(10_000):
        own = prose(20_000 + (i if i % 20 > 1 else i - i % 20), 15, 10**6).split()
        if i % 20 == 1:
            own[7] = f"other{i}"
        rows.append((i, " ".join([*base, *own, f"end{i}"])))
    got = run(spark, rows, M.ForestOptions(far_reach=16))
    assert all(got[i][1] == got[i - 1][1] == i - 1 for i in range(1, 10_000, 20))
    assert all(c == i for i, (_, c) in got.items() if i % 20 != 1)


def test_null_ids_of_the_query(spark, tmp_path):
    spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "x y z"), (3, None)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in M.op4_minhash_forest(spark, str(tmp_path)).collect())
    assert got == [("3", 0, "3", True), ("7", 2, "7", True), ("None", 1, "None", True), ("None", 2, "7", False)]


def test_without_broadcasts(spark):
    rows = [(i, edited(prose(i // 4, 80), 0.005, i)) for i in range(40)]
    assert run(spark, rows, M.ForestOptions(broadcast_ids=0)) == plain(rows)


def test_the_whole_small_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.op4_minhash_forest(spark, sf).collect()}
    assert got == plain(rows)


def test_dropping_keeps_the_smallest_id_and_all_columns(spark, odd, nothing, clashing):
    out = M.drop_near_duplicates(odd)
    assert out.columns == odd.columns and out.schema == odd.schema
    got = sorted((str(r.doc_id), (r.text or "")[:20]) for r in out.collect())
    want = sorted((str(r.doc_id), (r.text or "")[:20]) for r in odd.collect())
    want.remove(("8", "the same row twice, "))
    assert got == want  # a row that repeats id and text goes, rows of null ids stay
    assert M.drop_near_duplicates(nothing).count() == 0
    both = M.drop_near_duplicates(clashing)
    assert both.columns == clashing.columns and both.count() == out.count() and both.where("dkey = 'own dkey'").count() == out.count()
    pair = odd.limit(0).select("doc_id", "text").union(odd.sparkSession.createDataFrame([(7, "a b c d e f g"), (3, "A b c d e f  g"), (9, "other words that differ")], DOCS))
    assert sorted(r.doc_id for r in M.drop_near_duplicates(pair).collect()) == [3, 9]
    assert M.drop_near_duplicates(pair.where(F.col("doc_id") < 0)).count() == 0


@pytest.mark.parametrize("n", [1, 5, 300])
def test_signatures_estimate_similarity(n):
    import numpy as np

    a, b = M._parameters(M.LONG)
    h = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    same = (M.signature(h, a, b) == M.signature(h[::-1].copy(), a, b)).all()
    assert same
