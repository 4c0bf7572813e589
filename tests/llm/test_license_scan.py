import zstandard

from textloom.llm import license_scan as L


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.scan_licenses(docs).collect()}


def test_every_template_names_its_license(spark):
    texts, want = [], []
    for name, wordings in L.TEMPLATES.items():
        for w in wordings:
            texts.append(f"some words of a text\n\n{w}\n\nand more words")
            want.append(name)
    got = scan(spark, texts)
    assert [got[i].license for i in range(len(texts))] == want
    assert all(got[i].n_differences == 0 and got[i].line == 2 for i in range(len(texts)))


def test_wrapped_and_slightly_changed_wordings(spark):
    mit = L.TEMPLATES["MIT"][2]
    words = mit.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    changed = " ".join("whoever" if i in (10, 40) else w for i, w in enumerate(words))
    got = scan(spark, [wrapped, changed, "The license of a driver is on the table.", "Licensed under the  APACHE license, version 2.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0."])
    assert [got[i].license for i in range(6)] == ["MIT", "MIT", None, "Apache-2.0", "CC-BY-SA-4.0", "CC-BY-4.0"]
    assert got[1].n_differences == 2 and got[2].n_blocks == 1


def test_published_layouts(spark):
    """Paragraphs and wraps as published, bare and as comments: MIT, GPL, Apache and BSD in several paragraphs, all others wrapped."""
    from textwrap import wrap

    breaks = ("The above copyright notice and", "This program is distributed in the hope", "You may obtain a copy", "Unless required by", "1. Redist", "2. Redist", "3. Neither", "Permission to use, copy", "Anyone is free to copy")
    texts, want = [], []
    for name, wordings in L.TEMPLATES.items():
        for w in wordings:
            for b in breaks:
                w = w.replace(b, "\n\n" + b)
            for width, lead in ((72, ""), (50, " * "), (30, "# ")):
                lines = [x for p in w.strip().split("\n\n") for x in [*wrap(p, width), ""]]
                for title in ("Copyright (c) 2020 A Person\n\n", "A file of a program.\n"):
                    texts.append("\n".join(lead + x for x in [*title.split("\n")[:-1], *lines, "int main and more words"]))
                    want.append(name)
    texts.append("\n".join([f"line {i} of a long text that goes on" for i in range(40)] + wrap(L.TEMPLATES["GPL-2.0"][1], 60) + [f"and line {i} of other things" for i in range(40)]))
    got = scan(spark, texts)
    assert [(i, got[i].license, texts[i]) for i in range(len(want)) if got[i].license != want[i]] == []
    assert got[len(want)].license == "GPL-2.0"


def test_savings_are_those_of_the_raw_dictionary():
    s = L._Scanner(L.LicenseOptions())
    text = L.TEMPLATES["ISC"][0]
    folded = " ".join(text.lower().split()).encode()
    d = zstandard.ZstdCompressionDict(folded, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    alone = len(zstandard.ZstdCompressor(9, write_content_size=False).compress(folded))
    with_it = len(zstandard.ZstdCompressor(9, dict_data=d, write_content_size=False).compress(folded))
    best = s.judge(text)
    assert best[3] == "ISC" and abs(-best[2] - (alone - with_it) / alone) < 1e-12


def test_differences_count_words():
    t = "a b c d e f".split()
    assert L.differences("x y a b c d e f z".split(), t) == 0
    assert L.differences("a b q d e f".split(), t) == 1
    assert L.differences("a b d e f".split(), t) == 1
    assert L.differences("x y z".split(), t) == 6


def test_planted_lines_of_the_tables(spark):
    import re

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.license for r in L.op7_license_scan(spark, sf).collect()}
    plain = {" ".join(L.WORD.findall(w.lower())): name for name, ws in L.TEMPLATES.items() for w in ws}
    seen = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        names = [plain[k] for line in (r.text or "").split("\n") if (k := " ".join(re.findall(L.WORD, line.lower()))) in plain]
        if names:
            seen += 1
            assert got[r.doc_id] in names
        else:
            assert got[r.doc_id] is None
    assert seen > 3


def test_odd_rows(odd, nothing, clashing):
    rows = L.scan_licenses(odd).collect()
    assert len(rows) == odd.count() and {r.license for r in rows} == {None} and {r.n_blocks for r in rows} == {0}
    assert L.scan_licenses(nothing).count() == 0
    assert sorted(map(str, L.scan_licenses(clashing).collect())) == sorted(map(str, rows))
