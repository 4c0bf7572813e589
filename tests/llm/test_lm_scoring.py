import math
from collections import Counter

import numpy as np
from conftest_llm import prose
from test_sentencepiece import segmentations

from textloom.llm import lm_scoring as L
from textloom.llm.pieces import Pieces, read_vocabulary

SCHEMA = "doc_id long, text string, held_out boolean"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [""]


def plain(rows):
    counts = Counter(t for _, text, held in rows if not held for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(t := tokens(text)), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) for i, text, _ in rows}


def run(spark, rows, **options):
    out = L.lm_scores(spark.createDataFrame(rows, SCHEMA), L.LmOptions(**options))
    return {r.doc_id: r for r in out.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for i, (n, known, train, base) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, train)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base))


ROWS = [(i, prose(i, 5 + 20 * i) + " Own" + str(i), i % 3 == 2) for i in range(12)] + [(20, "", False), (21, None, True), (22, "WORD word wOrD\n\tx", False), (23, "z" * 5000, True)]


def test_the_base_score(spark):
    same(run(spark, ROWS), plain(ROWS))


def test_rare_words_go_through_the_join(spark):
    for head in (0, 1, 30):
        same(run(spark, ROWS, head_words=head), plain(ROWS))


def test_without_training_rows(spark):
    rows = [(i, t, True) for i, t, _ in ROWS]
    same(run(spark, rows), plain(rows))


def test_the_lattice_score(spark):
    """With the training words' expected counts taken over all their segmentations, one by one."""
    rows = [(1, "the dog a", False), (2, "a dog", False), (3, "go the ö", True), (4, "", True)]
    prior = 50.0
    got = run(spark, rows, prior=prior)
    p = Pieces(read_vocabulary())
    counts = Counter(t for _, text, held in rows if not held for t in tokens(text))
    n = np.zeros(p.size)
    for w, c in counts.items():
        if w:
            every = list(segmentations(p, " " + w))
            top = np.logaddexp.reduce([x for _, x in every])
            for s, x in every:
                for piece in s:
                    n[piece] += c * math.exp(x - top)
    weight = n + prior * np.exp(p.log_weight)
    end = (counts[""] + 0.5) / (counts[""] + n.sum() + 1)
    with np.errstate(divide="ignore"):
        p.log_weight = np.log(weight / weight.sum()) + math.log1p(-end)
    for i, text, _ in rows:
        want = math.log(end) + sum(np.logaddexp.reduce([x for _, x in segmentations(p, " " + w)]) for w in tokens(text) if w)
        assert abs(got[i].score - want / math.log(10)) < 1e-6 * max(1, abs(want))


def test_training_words_help_on_held_out_texts(spark):
    """Against the vocabulary's own scores (an endless prior)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("held_out", L.fold("doc_id", 7) == 2)
    learnt, own = (L.lm_scores(docs, L.LmOptions(prior=x)).where("held_out").selectExpr("sum(score)").first()[0] for x in (10_000.0, 1e18))
    assert learnt > own + 0.1 * abs(own)


def test_odd_rows(odd, nothing, clashing):
    from pyspark.sql import functions as F

    held = lambda d: d.withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    rows = L.lm_scores(held(odd)).collect()
    assert len(rows) == odd.count() and all(r.n_tokens >= 1 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.n_tokens for r in rows if r.doc_id == 6} == {40_001}
    assert L.lm_scores(held(nothing)).count() == 0
    assert sorted(str(r) for r in L.lm_scores(held(clashing)).collect()) == sorted(map(str, rows))
