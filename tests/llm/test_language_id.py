import math

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import language_id as L

SF = "/root/testdata/sf0.01"


def plain(grams: dict[bytes, int], size: int, symbol, text: bytes, order: int) -> float:
    """Log-probability of text by escape method C with exclusion, symbol by symbol."""
    counts: dict[tuple, dict[int, int]] = {}
    for g, n in grams.items():
        s = [symbol[b] for b in g]
        for depth in range(order + 1):
            ctx = tuple(s[order - depth : order])
            at = counts.setdefault(ctx, {})
            at[s[order]] = at.get(s[order], 0) + n

    def chance(ctx: tuple, x: int, allowed: set[int]) -> float:
        seen = {k: v for k, v in counts.get(ctx, {}).items()}
        if not seen:
            return chance(ctx[1:], x, allowed) if ctx else 1 / size
        n, d = sum(seen.values()), len(seen)
        rest = [k for k in range(size) if k not in seen]
        below = (lambda k: chance(ctx[1:], k, allowed)) if ctx else (lambda k: 1 / size)
        if not rest:
            return seen[x] / n
        if x in seen:
            return seen[x] / (n + d)
        return d / (n + d) * below(x) / sum(below(k) for k in rest)

    history = [symbol[32]] * order
    total = 0.0
    for b in text:
        x = symbol[b]
        total += math.log(chance(tuple(history), x, set()))
        history = [*history[1:], x]
    return total


def test_code_lengths_are_those_of_escape_method_c():
    order = 2
    texts = {"a": b"abab abba abc", "b": b"cc ac ab bcb"}
    lang, gram, n, by = [], [], [], {}
    for k, t in texts.items():
        padded = b" " * order + t
        by[k] = {}
        for i in range(len(t)):
            g = padded[i : i + order + 1]
            by[k][g] = by[k].get(g, 0) + 1
        for g, c in by[k].items():
            lang.append(k)
            gram.append(int.from_bytes(g))
            n.append(c)
    m = L.PpmModel.fit(np.array(lang, object), np.array(gram), np.array(n), order)
    tests = [b"abba", b"", b"ABc zz", b"cb", b"x"]
    off = np.cumsum([0, *map(len, tests)])
    got = m.score(np.frombuffer(b"".join(tests), np.uint8), off)
    for i, t in enumerate(tests):
        for k, name in enumerate(m.languages):
            assert abs(got[i, k] - plain(by[name], m.size, m.symbol.tolist(), t, order)) < 1e-3


def test_windows_do_not_change_scores(monkeypatch):
    m = L.PpmModel.fit(np.array(["a", "b"], object), np.array([0x20202061, 0x20206162]), np.array([3, 4]), 3)
    texts = [b"abcab" * 7, b"", b"b", b"aab" * 30]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = m.score(data, off)
    monkeypatch.setattr(L, "WINDOW", 5)
    assert np.allclose(whole, m.score(data, off), atol=1e-4)


def test_held_out_accuracy(spark):
    out = L.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    held = out.where("held_out and lang is not null and n >= 60")
    right = held.where("lang = lang_pred").count()
    assert right >= 0.97 * held.count() > 0
    assert out.where("score < 0 or score > 1").count() == 0


def test_odd_rows(spark, odd, nothing, clashing):
    model = L.fit(odd)
    got = [tuple(r) for r in L.predict(odd, model).collect()]
    assert len(got) == odd.count()
    by = {}
    for i, lang, score in got:
        by.setdefault(i, []).append((lang, score))
    assert by[1] == by[2] == by[3] == by[4] == [("und", 0.0)]
    assert all(lang in model.languages for lang, _ in by[6] + by[7] + by[9])
    assert by[8][0] == by[8][1] or by[8][0] == by[8][2]
    assert L.fit(nothing) is None and L.predict(nothing, None).count() == 0
    assert {r.lang_pred for r in L.predict(odd, None).collect()} == {"und"}
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in L.predict(clashing, model).collect())


def test_a_language_of_one_very_long_row_is_learned(spark):
    alphabets = {"aa": "abc", "bb": "def", "cc": "ghi", "dd": "jkl"}
    words = lambda letters, n: " ".join(letters[i % 3] * (1 + i % 4) for i in range(n))
    rows = [(i, words(letters, 20_000), lang) for i, (lang, letters) in enumerate(alphabets.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, L.LanguageIdOptions(sample_chars=100, sample_rows=1))
    assert model.languages == list(alphabets)
    new = spark.createDataFrame([(i, words(letters, 9), None) for i, letters in enumerate(alphabets.values())], docs.schema)
    assert [r.lang_pred for r in L.predict(new, model).orderBy("doc_id").collect()] == list(alphabets)
