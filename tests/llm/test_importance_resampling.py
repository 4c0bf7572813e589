import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import prose
from conftest_twin import same, twin
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import importance_resampling as R
from textloom.llm.common import buffers
from textloom.llm.decontamination import words as words_column

SF = "/root/testdata/sf0.001"
OUT = ["doc_id", "n_features", "weight", "score", "rank"]


def words(text):
    out, now = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if ord(c) > 0x7F or "a" <= c <= "z" or "0" <= c <= "9":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def grams(text, n=2):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.\n1漢", max_size=12)), max_size=5), st.integers(1, 3))
def test_features(texts, n):
    data, off = buffers(pa.array(texts, pa.string()))
    got, of, count = R.features(data, off, n)
    assert Counter(zip(of.tolist(), got.to_pylist(), strict=True)) == Counter((i, g) for i, t in enumerate(texts) for g in grams(t, n))
    assert count.tolist() == [len(words(t)) for t in texts]


def plain(docs, target, o):
    """weight by direct hashing of every feature."""
    bucket = lambda f: zlib.crc32(f.encode()) % o.buckets
    s, t = (Counter(bucket(f) for x in side for f in grams(x, o.ngrams)) for side in ([x for _, x in docs], target))
    big, small = s.total() + o.buckets, t.total() + o.buckets
    out = []
    for i, x in docs:
        f = grams(x, o.ngrams)
        g = sum(math.floor(1000 * math.log((t[b] + 1.0) * big / ((s[b] + 1.0) * small))) for b in map(bucket, f))
        out.append((i, len(words(x)), len(f), g // len(f) if f else 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [R.ResamplingOptions(), R.ResamplingOptions(head=0), R.ResamplingOptions(head=7, buckets=64, ngrams=3), R.ResamplingOptions(head=50, head_rows=3)])
def test_against_direct_hashing(spark, options, monkeypatch):
    docs = [(i, prose(i, 5 + i % 90, 60 + i)) for i in range(120)] + [(3, "twice " * 30)] * 2 + [(None, "no id here"), (4, None), (5, ""), (6, "..."), (7, "Ünï漢字 " * 40), (8, "long" * 9000), (8, "other")]
    target = [prose(500, 40, 60), None, "", "Ünï漢字"]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = sorted(((r.doc_id, r.n_words, r.n_features, r.weight) for r in R.weights(d, t, options).collect()), key=str)
    assert got == plain(docs, target, options)


def test_query_against_twin(spark):
    got = same(R.op12_importance_resampling(spark, SF), twin(R.OP12_SQL, SF))
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_odd_rows_against_twin(spark, odd, clashing):
    bench = spark.createDataFrame([(1, "word word the same row"), (2, None)], "item_id long, text string")
    more = spark.createDataFrame([(100 + i, prose(i, 25), "en", "s", 1) for i in range(40)], odd.schema)
    docs = odd.where("text is null or doc_id is null or doc_id not in (6, 7)").union(more)
    frames = {"documents": docs, "benchmark": bench}
    assert same(R.draw(R.weights(docs, bench)).select(OUT), twin(R.OP12_SQL, SF, frames))
    rows = lambda df: sorted(map(str, R.draw(R.weights(df, bench)).select(OUT).collect()))
    own = clashing.withColumns({c: F.lit("own") for c in ("hash", "target", "weight", "w", "n_words", "total")})
    assert rows(own) == rows(odd)


def test_empty_tables(spark, nothing, odd):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert R.draw(R.weights(nothing, bench)).collect() == []
    assert R.draw(R.weights(odd, bench.limit(0))).count() == odd.count()


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, 20, 1, 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long")
    got = [(r.score, r.doc_id, r.rank) for r in R.draw(df).collect()]
    want = sorted(got, key=lambda x: (-x[0], x[1]))
    assert [x[2] for x in want] == [*range(1, 101), *[None] * 300]


def test_parts_of_the_dictionary_do_not_depend_on_the_block():
    names = ["", "a", "ab", "abcdefgh", "abcdefghi", "é" * 9, "b"]
    at = lambda x: R._part(*R._loads(pa.array(x, pa.large_string())), 97).tolist()
    assert at(names) == [at([n])[0] for n in names]
    assert len(set(at([f"w{i} v{i}" for i in range(3000)]))) == 97


def test_gumbel_noise_of_fixed_ids(spark):
    import hashlib

    got = spark.range(50).select("id", R.noise(F.col("id"), 7).alias("x")).collect()
    for r in got:
        h = int(hashlib.sha256(f"7:{r.id}".encode()).hexdigest()[:8], 16)
        assert r.x == math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def test_words_are_those_of_the_contract(spark):
    texts = ["ΟΔΟΣ.w0", "A-b_c9", "İstanbul ẞ", "x\u0000y"]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "text string").select(words_column(F.col("text")).alias("w")).collect()]
    assert got == [words(t) for t in texts]
    data, off = buffers(pa.array(texts))
    assert [g for g in R.features(data, off, 1)[0].to_pylist()] == sum(got, [])
    assert np.array_equal(R.features(data, off, 1)[2], [len(w) for w in got])


@given(st.lists(st.text(alphabet="ab é漢", max_size=12), min_size=1, max_size=30))
@settings(deadline=None)
def test_strings_come_back(names):
    names = sorted(set(names), key=lambda x: x.encode())
    array = pa.array(names, pa.large_string())
    data, off = buffers(array)
    assert R.unpack_strings(R.pack_strings(data, off, R._loads(array)[1]), len(names)).to_pylist() == names
