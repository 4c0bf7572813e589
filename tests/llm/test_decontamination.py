import hashlib
import random

import pytest
from conftest_llm import prose

from textloom.llm import decontamination as D


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


def plain(docs, items):
    """doc: (words, hit words, item ids as sorted strings, contaminated), window by window."""
    windows = [(str(i), w[k : k + min(13, len(w))]) for i, t in items if i is not None and (w := words(t)) for k in range(max(1, len(w) - 12))]
    out = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(name)
        out[i] = (len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w))
    return out


def run(spark, docs, items, **options):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.n_words, r.n_hit, r.items, r.contaminated) for r in D.decontaminated(d, b, D.DecontaminationOptions(**options)).collect()}


def made(seed):
    r = random.Random(seed)
    items = [(i, prose(i + seed, r.choice([3, 8, 12, 13, 14, 30]), 30)) for i in range(12)] + [(40, ""), (41, None), (None, prose(1, 20)), (42, "Short"), (43, prose(2 + seed, 13, 30)), (43, "the  same ITEM's id")]
    docs = []
    for i in range(40):
        body = prose(1000 + i + seed, r.choice([5, 60, 300]), 500).split()
        for _ in range(r.randrange(3)):
            w = (r.choice(items)[1] or "").split()
            a = r.randrange(max(1, len(w)))
            at = r.randrange(len(body))
            body[at:at] = [x.upper() if r.random() < 0.3 else x + r.choice(["", ",", "."]) for x in w[a : a + r.choice([5, 13, 20, 40])]]
        docs.append((i, " ".join(body)))
    return docs + [(100, items[0][1]), (101, ""), (102, None), (103, "Short"), (104, "short short"), (105, items[9][1] + " " + items[9][1])], items


@pytest.mark.parametrize("seed", [0, 7])
def test_against_all_windows(spark, seed):
    docs, items = made(seed)
    want = plain(docs, items)
    assert run(spark, docs, items) == want
    assert sum(x[3] for x in want.values()) > 2


def test_without_broadcasts(spark):
    docs, items = made(3)
    assert run(spark, docs, items, broadcast_rows=0) == plain(docs, items)


def test_the_contamination_rule_at_its_edge(spark):
    item = " ".join(f"q{i}" for i in range(13))
    docs = [(n, item + " " + " ".join(f"p{i}" for i in range(n - 13))) for n in (259, 260, 261)]
    assert {i: x[3] for i, x in run(spark, docs, [(1, item)]).items()} == {259: True, 260: True, 261: False}


def test_repeating_words_and_other_scripts(spark):
    docs = [(1, "la " * 50), (2, "x la la la la y"), (3, "naïve CAFÉ 漢字 É"), (4, "naïve café 漢字 É")]
    items = [(1, "la la la"), (2, "NAÏVE caf"), (3, "café 漢字"), (4, "naïve CAFÉ")]
    assert run(spark, docs, items) == plain(docs, items)


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    want = plain(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.op9_decontamination(spark, sf).collect()}
    assert got == {i: (n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), c) for i, (n, h, x, c) in want.items()}


def test_odd_rows(spark, odd, nothing, clashing):
    items = spark.createDataFrame([(1, "word word word"), (2, "the same row twice, with some more"), (None, None)], "item_id long, text string")
    out = D.decontaminated(odd, items)
    assert out.columns == [*odd.columns, "n_words", "n_hit", "items", "contaminated"]
    rows = out.collect()
    assert len(rows) == odd.count()
    assert [(r.n_words, r.n_hit, r.items) for r in rows if r.doc_id == 6] == [(40_000, 40_000, ["1"])]
    assert sorted(r.n_hit for r in rows if r.doc_id == 8) == [0, 7, 7]
    assert D.decontaminated(nothing, items).count() == 0
    assert {r.contaminated for r in D.decontaminated(odd, items.limit(0)).collect()} == {False}
    both = D.decontaminated(clashing, items)
    assert both.where("dkey = 'own dkey'").count() == len(rows)
    assert sorted(str((r.doc_id, r.n_hit, r["items"])) for r in both.collect()) == sorted(str((r.doc_id, r.n_hit, r["items"])) for r in rows)


def test_words_fold_only_latin_capitals(spark):
    """A Greek word ends in another sigma before a blank than before a full stop and a letter, if the whole text is lowered."""
    tail = " ".join(f"w{i}" for i in range(12))
    got = run(spark, [(1, f"ΟΔΟΣ.{tail}"), (2, f"x ΟΔΟΣ {tail}"), (3, f"οδος {tail}")], [(1, f"ΟΔΟΣ {tail}")])
    assert [got[i][1] for i in (1, 2, 3)] == [13, 13, 0]
