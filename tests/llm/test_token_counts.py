import pytest

from textloom.llm import token_counts as T

VOCABULARY = open(T.TokenCountOptions().vocabulary, "rb").read()


def plain(text: str, rule: str) -> list[tuple[float, int]]:
    """Each token's characters, one by one, against each line."""
    encoding, _ = T._encoding(VOCABULARY)
    sections, at = [], 0
    for line in text.splitlines(keepends=True) if "\r" not in text and "\x0b" not in text else text.split("\n"):
        sections.append((at, at + len(line)))
        at += len(line)
    lead, places = b"", []
    for i, ch in enumerate(text):
        places += [i] * len(ch.encode())
    out = [[0.0, 0] for _ in sections]
    done = 0
    for token in encoding.encode_ordinary(text):
        width = len(encoding.decode_single_token_bytes(token))
        chars = sorted(set(places[done : done + width]))
        done += width
        inside = [sum(a <= c < z for c in chars) for a, z in sections]
        hit = [k for k, n in enumerate(inside) if n]
        if len(hit) > 1:
            for k in hit:
                out[k][1] += 1
        if rule == "split":
            for k in hit:
                out[k][0] += inside[k] / len(chars)
        else:
            out[hit[0] if rule == "start" else max(hit, key=lambda k: (inside[k], -k))][0] += 1
    return [(round(n, 9), c) for n, c in out]


TEXTS = ["one line", "two\nlines", "a\n\n\n\n  b\n", "\n", "été 漢字 😀😀\n\n 😀", "trailing   \n   leading\n\n\n\n\n\n\nend", "x" * 300 + "\n" + "y z " * 50]


@pytest.mark.parametrize("rule", ["majority", "start", "split"])
def test_against_characters_one_by_one(spark, rule):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = T.section_token_counts(docs, options=T.TokenCountOptions(rule=rule)).orderBy("doc_id", "section").collect()
    for i, text in enumerate(TEXTS):
        got = [(round(float(r.n_tokens), 9), r.n_crossing) for r in rows if r.doc_id == i]
        assert got == plain(text, rule), text
        spans = [(r.char_start, r.char_end) for r in rows if r.doc_id == i]
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_sections_sum_to_the_documents_tokens(spark):
    sf = "/root/testdata/sf0.001"
    encoding, _ = T._encoding(VOCABULARY)
    want = {r.doc_id: len(encoding.encode_ordinary(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text}
    got = {r.doc_id: r.n for r in T.op2_token_counts(spark, sf).groupBy("doc_id").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert got == want


def test_odd_rows(odd, nothing, clashing):
    got = T.section_token_counts(odd)
    by = {r.doc_id for r in got.collect()}
    assert by == {None, 3, 4, 5, 6, 7, 8, 9, 10}  # null and empty texts have no sections
    assert got.where("doc_id = 8 and n_tokens = 0").count() == 0 and got.where("doc_id = 8").count() == 3
    assert T.section_token_counts(nothing).count() == 0
    assert sorted(map(tuple, T.section_token_counts(clashing).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    with pytest.raises(ValueError):
        T.TokenCountOptions(rule="other")


@pytest.mark.parametrize("rule", ["majority", "start", "split"])
def test_given_sections(spark, rule):
    text = "Title here\nThe body goes on, naïvely.\nEnd"
    docs = spark.createDataFrame([(1, text), (2, "x y z"), (3, None), (None, "a b")], "doc_id long, text string")
    cut = [(0, 11), (11, 38), (38, len(text))]
    spans = [(1, k, a, z) for k, (a, z) in enumerate(cut)] + [(2, 7, 1, 3), (2, 8, 2, 99), (2, 9, 5, 5), (3, 0, 0, 4), (4, 0, 0, 1)]
    given = spark.createDataFrame(spans, "doc_id long, section int, char_start long, char_end long")
    options = T.TokenCountOptions(rule=rule)
    got = T.section_token_counts(docs, options=options, sections=given).collect()
    lines = T.section_token_counts(docs.where("doc_id = 1"), options=options).collect()
    assert sorted(map(tuple, (r for r in got if r.doc_id == 1))) == sorted(map(tuple, lines))  # the same spans, told and found
    two = {r.section: (r.char_start, r.char_end, r.n_tokens) for r in got if r.doc_id == 2}
    assert two == {7: (1, 3, 1), 8: (3, 5, 1), 9: (5, 5, 0)}  # x, y and z are tokens; x is in no section
    assert {r.doc_id for r in got} == {1, 2}
