import numpy as np

from textloom.llm import toxicity as T


def test_later_links_are_trained_on_out_of_fold_probabilities(monkeypatch):
    seen = []
    real = T.fit_link

    def spy(x, extra, y, options):
        seen.append((x.n, extra.copy()))
        return real(x, extra, y, options)

    monkeypatch.setattr(T, "fit_link", spy)
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 50, 8)) for _ in range(90)]
    y = np.column_stack([r.integers(0, 2, 90), r.integers(0, 2, 90)]).astype(float)
    fold = np.arange(90) % 3
    options = T.ToxicityOptions(least_ratio=0.5)
    chain = T.Chain.fit(rows, y, fold, options)
    assert [n for n, _ in seen] == [90, 60, 60, 60, 90]  # the whole, each fold's rest, the next link
    own = real(T.Sparse([rows[i] for i in np.flatnonzero(fold != 0)]), np.zeros((60, 0)), y[fold != 0, 0], options)
    want = own.predict(T.Sparse([rows[i] for i in np.flatnonzero(fold == 0)]).dense(own.features), np.zeros((30, 0)))
    assert np.allclose(seen[-1][1][fold == 0, 0], want)
    assert chain.predict(rows).shape == (90, 2)


def test_weights_are_where_the_penalised_loss_is_flat():
    r = np.random.default_rng(1)
    x = T.Sparse([np.unique(r.integers(0, 9, 4)) for _ in range(200)])
    y = (x.dense(np.array([3]))[:, 0] + (r.random(200) < 0.1) > 0).astype(float)
    options = T.ToxicityOptions(l2=0.3)
    link = T.fit_link(x, np.zeros((200, 0)), y, options)
    assert 3 in link.features.tolist()
    a = np.column_stack([x.dense(link.features), np.ones(200)])
    slope = a.T @ (y - link.predict(a[:, :-1], np.zeros((200, 0)))) - np.r_[np.full(len(link.features), 0.3), 1e-3] * link.weights
    assert np.abs(slope).max() < 1e-2


def test_the_likelihood_ratio_of_each_feature():
    rows = [np.array(x) for x in ([1, 2], [1], [1, 3], [2], [3, 2], [])]
    y = np.array([1, 1, 1, 0, 0, 0.0])
    assert T.telling(T.Sparse(rows), y, T.ToxicityOptions(least_ratio=8.3)).tolist() == [1]  # 12 ln 2
    assert T.telling(T.Sparse(rows), y, T.ToxicityOptions(least_ratio=8.4)).tolist() == []


def test_words_and_their_beginnings():
    o = T.ToxicityOptions()
    assert T._Words(o).of(b"Word, (WORD) word") == T._Words(o).of(b"word") and len(T._Words(o).of(b"word")) == 1
    long = T._Words(o).of(b"lengthy lengthier !! ..")
    assert len(long) == 3  # two words, one beginning
    some = np.array(sorted(long))[:1]
    assert T._Words(o, some).of(b"other lengthy lengthier") == [0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = T.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = T.predict(docs, chain).join(labels.where("doc_id % 3 = 0 and toxic is not null").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic"), "doc_id").select("toxic", "rejected", "p_toxic").collect()
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert toxic and clean
    assert sum(r.rejected for r in toxic) >= 0.85 * len(toxic)  # some labels are noise
    assert sum(r.rejected for r in clean) <= 0.005 * len(clean)


def test_odd_rows(spark, odd, nothing, clashing):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, None, 1), (8, 0, 0), (9, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    chain = T.fit(odd, labels)
    out = T.predict(odd, chain)
    assert out.columns == [*odd.columns, "p_quality", "p_toxic", "rejected"]
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in rows)
    assert not any(r.rejected for r in rows if not (r.text or "").strip())
    assert T.fit(odd, labels.limit(0)) is None and T.fit(nothing, labels) is None
    assert {(r.p_toxic, r.rejected) for r in T.predict(odd, None).collect()} == {(0.0, False)}
    assert T.predict(nothing, chain).count() == 0
    both = T.predict(clashing, chain)
    assert both.where("removed = 'own removed'").count() == len(rows) and both.where("rejected").count() == out.where("rejected").count()


def test_the_sample_is_bounded_and_takes_the_rarer_class_first(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('w', id) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "1 as quality", "cast(id < 40 as int) as toxic")
    options = T.ToxicityOptions(sample_rows=300)
    sizes = []
    real = T.Chain.fit

    def spy(rows, y, fold, options):
        sizes.append((len(rows), int(y[:, 1].sum())))
        return real(rows, y, fold, options)

    T.Chain.fit = spy
    try:
        T.fit(docs, labels, options)
    finally:
        T.Chain.fit = real
    assert sizes[0][1] == 40 and sizes[0][0] <= 600


def test_the_driver_gives_back_what_the_fit_took(spark, monkeypatch):
    done = []
    monkeypatch.setattr(T, "release", lambda: done.append(True))
    docs = spark.createDataFrame([(i, f"text {i % 2}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    assert T.fit(docs, labels) is not None and done == [True]
