from conftest_llm import edited, prose

from textloom.llm import line_dedup as L
from textloom.llm.shingles import exact_shingles


def plain(rows, similarity=80):
    """(doc_id, text): removed lines, by comparing each line with all earlier ones."""
    lines, gone = [], {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")) if text is not None else ():
            s = exact_shingles(line)
            if s and any(100 * len(s & o) >= similarity * len(s | o) for o in lines):
                gone.setdefault((i, text), []).append(k)
            if s:
                lines.append(s)
    return {r: gone.get(r, []) for r in set(rows)}


def run(spark, rows, options=L.LineDedupOptions()):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.text): r.removed for r in L.dedup_lines(docs, options).collect()}


def corpus(n):
    rows = []
    for i in range(n):
        lines = []
        for k in range(4):
            base = prose((i * 7 + k) % 11, 8 + 3 * ((i * 7 + k) % 11))
            lines += [edited(base, (0, 0, 0.02, 0.05, 0.1)[(i + k) % 5], i * 10 + k), f"own line {i} {k} with words of its own {i * k}", ""]
        rows.append((i, "\n".join(lines)))
    return rows


def test_against_all_pairs_of_lines(spark):
    rows = corpus(40)
    want = plain(rows)
    assert run(spark, rows) == want
    assert sum(map(len, want.values())) > 20


def test_a_filter_loses_no_key(spark):
    import numpy as np

    bits = L.key_filter(spark.range(-50_000, 50_000, numPartitions=5).selectExpr("id * 7919 as h"))
    inside, outside = (np.arange(-50_000, 50_000) * 7919).view(np.uint64), (np.arange(-50_000, 50_000) * 7919 + 1).view(np.uint64)
    assert L._maybe(bits, inside).all() and L._maybe(bits, outside).sum() < 50
    assert not L._maybe(L.key_filter(spark.range(0).selectExpr("id as h")), inside).any()


def test_lines_that_a_filter_lets_pass():
    import numpy as np
    import pyarrow as pa

    class Every:
        value = np.full(L.FILTER_BITS // 8, 255, np.uint8)

    texts = ["", "\n", "a", "a\nb", "\n\n", "é\n漢\n", None, "x\n", "\ny", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["dkey", "text"])
    got = sorted((r["dkey"], r["line"], r["text"]) for b in L._wanted_lines(Every)([batch]) for r in b.to_pylist())
    assert got == [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]


def test_a_very_common_line(spark):
    rows = [(i, f"the one line that all of them have\nand line {i} of {i} that only {i} has\nThe ONE line  that all of them have") for i in range(300)]
    got = run(spark, rows)
    assert got == plain(rows) and got[rows[0]] == [2] and got[rows[5]] == [0, 2]


def test_matches_need_not_stay_themselves(spark):
    words = prose(3, 60).split()
    rows = [(i, " ".join(words[2 * i : 2 * i + 30])) for i in range(8)]  # each is like the one before only
    got = run(spark, rows)
    assert got == plain(rows) and [got[r] for r in rows] == [[], *([[0]] * 7)]


def test_the_whole_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {r[0]: ",".join(map(str, v)) for r, v in plain(rows).items()}
    assert {r.doc_id: r.removed_lines for r in L.op6_line_dedup(spark, sf).collect()} == want


def test_odd_rows(odd, nothing, clashing):
    out = L.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "removed", "deduped"]
    rows = out.collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, (r.text or "")[:12]): r for r in rows}
    assert by[(10, "a\nb\na\n\n\nb\nA\n")].removed == [2, 5, 6] and by[(10, "a\nb\na\n\n\nb\nA\n")].deduped == "a\nb\n\n\n"
    assert by[(1, "")].deduped is None and by[(2, "")].deduped == "" and by[(3, " \t\n\r \n")].removed == []
    twice = [r for r in rows if r.doc_id == 8 and r.text.startswith("the same row")]
    assert [r.removed for r in twice] == [[], []]
    assert L.dedup_lines(nothing).count() == 0
    both = L.dedup_lines(clashing)
    assert both.where("dkey = 'own dkey' and token = 'own token'").count() == len(rows)
    assert sorted(str((r.doc_id, r.removed, r.deduped)) for r in both.collect()) == sorted(str((r.doc_id, r.removed, r.deduped)) for r in rows)


def test_many_lines_of_one_document_go(spark):
    lines = [f"line {i % 700} of many with a number {i % 700} and other words {i % 700}" if i % 3 else "" for i in range(4200)]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.dedup_lines(docs).collect()}
    gone = set(plain([(1, text)])[(1, text)])
    assert got[1].removed == sorted(gone) and len(gone) > 1000
    assert got[1].deduped == "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert (got[2].deduped, got[3].deduped) == ("", None)


def test_sets_of_one_class_number_stay_apart(spark, monkeypatch):
    """Two lines whose first hashes name one class are told apart by the second."""
    import numpy as np

    from textloom.llm.common import packed
    from textloom.llm.shingles import stretches

    docs = packed(spark.createDataFrame([(1, "a b c d e f\nf e d c b a\nA b c  d e f")], "doc_id long, text string"), "doc_id", "text").toArrow()
    (_, _, data, off), *_ = stretches(docs.column("text"))
    h, line, every, other = L._tokens(data, off, twice=True)
    assert len(every) == 3 and len(h) == len(other) == 6
    assert np.array_equal(np.sort(other[line == 0]), np.sort(other[line == 2]))
    assert not set(other[line == 0]) & set(other[line == 1]) and not set(h) & set(other)


def test_texts_are_not_shuffled_for_the_numbers_of_lines(spark):
    out = L.op6_line_dedup(spark, "/root/testdata/sf0.001")
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    dealt = [part for part in plan.split("\n\n") if ") Exchange\n" in part]
    assert dealt and not any("text#" in part for part in dealt)


def test_a_filter_that_lets_all_pass_changes_nothing(spark, monkeypatch):
    import numpy as np

    rows = corpus(25) + corpus(2)
    want = run(spark, rows)
    monkeypatch.setattr(L, "key_filter", lambda keys: np.full(L.FILTER_BITS // 8, 255, np.uint8))
    assert run(spark, rows) == want == plain(rows)


def test_bins_tell_what_comes_with_more_than_one(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(L, "HELD", 300)
    r = np.random.default_rng(5)
    batches, want = [], {}
    for _ in range(7):
        n = r.integers(0, 6, 50)
        token = r.integers(0, 2**64, 400, np.uint64)[r.integers(0, 400, n.sum())] if n.sum() else np.zeros(0, np.uint64)
        token[::9] = 7  # many have it
        cls, dkey, line = r.integers(-20, 20, 50) << 40, r.integers(0, 5, 50), r.integers(0, 5, 50).astype(np.int32)
        packed = [x.tobytes() for x in np.split(token, np.cumsum(n)[:-1])]
        whole = pa.RecordBatch.from_arrays([pa.array([1, *cls]), pa.array([1, *dkey]), pa.array([1, *line], pa.int32()), pa.array([b"12345678", *packed])], names=["cls", "dkey", "line", "tokens"])
        batches.append(whole.slice(1))
        for c, d, k, x in zip(cls, dkey, line, np.split(token, np.cumsum(n)[:-1]), strict=True):
            want.setdefault(int(L._class_key(np.array([c]))[0]), set()).add((d, k))
            for h in x.tolist():
                want.setdefault(h, set()).add(c)
    rows = pa.Table.from_batches(list(L._dealt(batches))).sort_by("bin").combine_chunks().to_batches()
    got = np.concatenate([b.column("h").to_numpy() for b in L._repeated(rows)]).view(np.uint64).tolist()
    assert len(got) == len(set(got)) and set(got) == {h for h, x in want.items() if len(x) > 1} and 7 in got
    assert not list(L._dealt([])) and not list(L._repeated([]))
