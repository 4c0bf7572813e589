import math

import numpy as np

from textloom.llm import sentencepiece_sampling as S
from textloom.llm.pieces import Pieces, read_vocabulary


def segmentations(p: Pieces, text: str):
    """All ways to spell text in pieces, with their log weights."""
    if not text:
        yield (), 0.0
        return
    for k in range(1, len(text) + 1):
        i = p.known.get(text[:k], -1)
        if i >= 0:
            for rest, w in segmentations(p, text[k:]):
                yield (i, *rest), w + p.log_weight[i]
        elif k == 1:
            spelt = p.spelt(text[0])
            for rest, w in segmentations(p, text[1:]):
                yield (*spelt, *rest), w + sum(p.log_weight[j] for j in spelt)


def test_samples_follow_the_lattice():
    p = Pieces(read_vocabulary())
    every = dict(segmentations(p, " the"))
    top = np.logaddexp.reduce(list(every.values()))
    n = 60_000
    ids, sizes = S.Sampler(p).encode(["the"] * n, np.random.default_rng(1).integers(0, 2**63, n, dtype=np.uint64))
    cut = np.r_[0, np.cumsum(sizes)]
    counts: dict[tuple, int] = {}
    for a, z in zip(cut[:-1], cut[1:]):
        counts[tuple(ids[a:z].tolist())] = counts.get(tuple(ids[a:z].tolist()), 0) + 1
    assert set(counts) <= set(every)
    for s, w in every.items():
        q = math.exp(w - top)
        assert abs(counts.get(s, 0) / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3


def test_forward_sums_are_those_of_all_segmentations():
    p = Pieces(read_vocabulary())
    for text in (" dogs", " a", " über", " 漢a"):
        assert abs(p.forward(text) - np.logaddexp.reduce([w for _, w in segmentations(p, text)])) < 1e-9


def test_round_trip_and_reproducible(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r.ids for r in S.encode_rows(docs.repartition(7)).collect()}
    two = S.encode_rows(docs.coalesce(1)).collect()
    assert all(r.lossless for r in two if r.ids is not None)
    assert {r.doc_id: r.ids for r in two} == one
    other = {r.doc_id: r.ids for r in S.encode_rows(docs, options=S.SamplingOptions(seed=1)).collect()}
    assert other != one


def test_stretches_do_not_change_samples(monkeypatch):
    s = S.Sampler(Pieces(read_vocabulary()))
    texts, keys = ["a few words\nand lines  with spaces", "", "x" * 50, "b\n\n c"], np.arange(4, dtype=np.uint64)
    whole = s.encode(texts, keys)
    monkeypatch.setattr(S, "CHARS", 7)
    parts = s.encode(texts, keys)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_odd_rows(odd, nothing, clashing):
    rows = S.encode_rows(odd).collect()
    p = Pieces(read_vocabulary())
    texts = sorted((str(r.doc_id), r.text or "", r.text is None) for r in odd.collect())
    assert sorted((str(r.doc_id), "" if r.ids is None else S.decode(p, r.ids), r.ids is None) for r in rows) == texts
    assert all(r.lossless is None if r.ids is None else r.lossless for r in rows)
    same = [r.ids for r in rows if r.doc_id == 8]
    assert same[0] == same[1] or same[0] == same[2] or same[1] == same[2]
    assert S.encode_rows(nothing).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, S.encode_rows(clashing).collect()))
