"""What keeps a query's work in proportion to its table: shuffles, tasks, and the sizes held at a time."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import json_tables
from textloom.plans import registry

JSONS = [
    (1, '{"k":1,"items":[{"a":1,"b c":[1,{"d":null}]},5,{"e":"x"}],"later":[{"no":1}]}'),
    (2, '[{"a":1},{"a":"2","b":{}},[3],null]'),
    (3, '"plain"'),
    (4, "[]"),
    (5, "{"),
    (6, None),
    (7, '{"n":{"a":[[1],["t"]]}}'),
]


def shuffles(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(JSONS, "id int, doc string")


def test_texts_meet_without_a_shuffle(texts):
    t, m = json_tables.tables(texts, "id", "doc"), json_tables.merged_shapes(texts, "id", "doc")
    for df in (json_tables.cells(texts, "id", "doc"), json_tables.table_rows(t, "id"), json_tables.table_summary(t, "id"), json_tables.table_files(t, "id"), json_tables.stats(texts, "id", "doc"), json_tables.shapes(texts, "id", "doc"), json_tables.written_declarations(m, "id")):
        assert shuffles(df) == 0


def test_a_row_a_text_gives_what_rows_of_cells_give(texts):
    cells, t = json_tables.cells(texts, "id", "doc"), json_tables.tables(texts, "id", "doc")
    assert rows(json_tables.table_rows(t, "id").drop("columns")) == rows(json_tables.rows(cells, "id"))
    assert rows(json_tables.table_summary(t, "id")) == rows(json_tables.summary(cells, "id"))
    assert rows(json_tables.table_files(t, "id", crlf=True)) == rows(json_tables.delimited_text(cells, "id", crlf=True))
    shapes = json_tables.shapes(texts, "id", "doc")
    assert rows(json_tables.written_declarations(json_tables.merged_shapes(texts, "id", "doc"), "id")) == rows(json_tables.declarations(shapes, "id"))


def test_places_of_cells_are_those_of_nodes(texts):
    for arrays in ("index", "json"):
        cells = json_tables.cells(texts, "id", "doc", json_tables.TableOptions(arrays=arrays))
        nodes = json_tables.tree(texts, "id", "doc", texts=True)
        assert cells.where("value <> ''").count() == cells.where("value <> ''").join(nodes, ["id", "pos"]).where(cells["value"] == nodes["value"]).count()


def test_few_nodes_are_held_at_a_time():
    import pyarrow as pa

    many = pa.RecordBatch.from_arrays([pa.array([json.dumps([{"a": i}] * 10) for i in range(2000)])], names=["_json"])
    held = [sum(map(len, found)) for _, found in json_tables._walked(many, lambda v: json_tables._walk(v, False))]
    assert sum(held) == 2000 * 21 and max(held) < json_tables.MOST_NODES + 21


def test_a_small_table_is_dealt_to_many_tasks(spark):
    few = registry.spread(spark.range(100).coalesce(1), "id").withColumn("p", F.spark_partition_id())
    assert few.rdd.getNumPartitions() >= 4 and few.select("p").distinct().count() >= 4


def test_hints_are_computed_once(spark):
    from textloom.operators import resume

    cv = spark.createDataFrame([(1, "Experience\n- responsible for many reports and for various other things\n- cut cost by 12%")], "id int, cv string")
    df = resume.coaching(resume.lines(cv, "id", "cv"), "id")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("responsible for") == 1
    assert [r.hints for r in df.orderBy("line_no").collect()] == [["open with what you did", "say how much"]]


def test_phrases_are_looked_for_in_words_made_once_a_text(spark):
    from textloom.operators import resume_checks

    cvs = spark.createDataFrame([(1, "Spark, SQL & c++ models")], "id int, cv string")
    adverts = spark.createDataFrame([(1, "we want spark and sql and model, spark and sql and model; c++ and c++, java or java")], "id int, advert string")
    df = resume_checks.advert_coverage(cvs, "id", "cv", adverts)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9+#./ -]") == 1
    assert {r.term: r.present for r in df.collect()} == {"spark": True, "sql": True, "model": True, "c++": True, "java": False}


def test_search_of_equal_rows_goes_by_key(spark):
    from textloom.operators import relations

    parts = spark.createDataFrame([(k, "cold bolt", 1.0) for k in (5, 3, 9, 1, 7)], "k int, n string, p double")
    assert [r.k for r in relations.search(parts, "n", "bolt", "p", 3, key="k").collect()] == [1, 3, 5]


def test_nodes_of_two_sides_meet_within_their_texts(spark):
    from textloom.operators import jsons

    a = spark.createDataFrame([(1, '{"x":{"y":1,"z":[]},"s":"A","n":null}'), (2, "[1]"), (3, "{")], "id int, doc string")
    b = spark.createDataFrame([(1, '{"x":3,"s":"a","n":null,"m":{"k":[1]}}'), (3, "7")], "id int, doc string")
    df = jsons.diff(a, b, "id", "doc")
    assert "path" not in str(df._jdf.queryExecution().executedPlan()).split("MapInArrow")[-1].split("Exchange")[-1]
    assert sorted(map(tuple, df.collect()), key=str) == [
        (1, "$.m", "added", None, "object"),
        (1, "$.s", "changed", "A", "a"),
        (1, "$.x", "type", "object", "3"),
        (2, "$", "removed", "array", None),
        (3, "$", "added", None, "7"),
    ]
    same = jsons.diff_stats(df, a, b, "id", "doc").orderBy("id").collect()
    assert [(r.id, r.unchanged) for r in same] == [(1, 1), (3, 0)]
    assert jsons.diff_counts(a, b, "id", "doc").orderBy("id").collect() == same


def test_only_what_is_not_ascii_is_cut_into_graphemes(spark):
    import regex

    from textloom.operators import frequency

    texts = ["a\r\nb\r\r\n\n", "x́y \ŕ\n", "\r\ń", "é\r\ńe", "؀1 2", "é1é\ré\né", "1️⃣ #", "\x1f\x7f́", "漢a字‍a", "$+€ .,«\t ", "\U0001f469‍\U0001f469‍\U0001f467ok", ""]
    names = ("emoji", "letters", "digits", "whitespace", "punctuation", "symbols", "other")
    patterns = (r".*\p{Extended_Pictographic}.*", r"\p{L}\p{M}*", r"\p{Nd}", r"[\s ﻿\p{Zs}]", r"\p{P}", r"\p{S}", r"(?s:.*)")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *(c.alias(n) for n, c in frequency.grapheme_classes(F.col("t")).items()))
    assert r"[\x20-\x7E]?[^\x00-\x7F]+" in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        kinds = [next(n for n, p in zip(names, patterns, strict=True) if regex.fullmatch(p, g)) for g in regex.findall(r"\X", texts[r.i])]
        assert [r[n] for n in names] == [kinds.count(n) for n in names], texts[r.i]


def test_lines_are_split_once_for_all_delimiters(spark):
    from textloom.operators import delimited

    texts = ['a,b;"c,d"\n\n1,2;3', "x", "", None, "p|q|r\np|q", 'é\tü\té\r\né\t"a\tb"\té', "  \n"]
    df = delimited.detect(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('"(?:[^"]|"")*"') == 1 and plan.count(r"\r\n|\r|\n") == 1
    got = [(r.delimiter, r.confidence, r.columns) for r in df.orderBy("i").collect()]
    assert got == [(",", 1.0, 2), (",", 0.0, 0), (",", 0.0, 0), (",", 0.0, 0), ("|", 0.5, 3), ("\t", 1.0, 3), (",", 0.0, 0)]


def test_phrases_are_rows_of_a_few_tokens(spark):
    from textloom.operators import skills

    texts = ["a b,c. d", "go,go.js a  b", ",x a b. c", "", None, "x.y.z a", "GO a b"]
    named = ["a", "a b", "b,c", "go", "go,go", "x", "x.y", "a ", "a b. c", "c"]
    df = skills.known_skills(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", spark.createDataFrame([(n,) for n in named], "skill string"))
    plan = df._jdf.queryExecution()
    assert "sequence(0" not in plan.optimizedPlan().toString() and "BroadcastHashJoin" in plan.executedPlan().toString()
    want = {(i, n) for i, t in enumerate(texts) if t is not None for n in named if any(f" {n}{e}" in f" {t.lower()} " for e in " ,.")}
    assert {(r.k, r.skill) for r in df.collect()} == want
    wanted = spark.createDataFrame([("f", n) for n in named if n.strip() == n], "f string, skill string")
    of = skills.field_skills(spark.createDataFrame([(1, "f", "a bs x"), (2, "f", None), (3, "g", "a")], "k int, f string, t string"), "k", "t", "f", wanted)
    assert "sequence(0" not in of._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.present for r in of.collect()} == {1: ["a", "a b", "x"], 2: [], 3: []}


def test_lines_of_cvs_are_held_for_all_that_reads_them(spark):
    from textloom.operators import resume, resume_checks

    cv = "Jo Doe\nExperience\nEngineer at Acme, 2001 - 2003\n- responsible for many reports\nSkills\nSQL, Spark\nEducation\nBSc"
    cvs = registry.spread(spark.createDataFrame([(1, cv), (2, None), (3, "x")], "id int, cv string"), "id")
    lines = resume.lines(cvs, "id", "cv")
    held = resume.rows(resume.held(lines, "id", 2), "id")
    marked = resume.marked_lines(resume.role_lines(held, "id", 24300), "id")
    again = resume.rows(resume.held(marked, "id", 1), "id")
    dealt = [df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") for df in (lines, held, again)]
    assert dealt == [1, 2, 3]  # a shuffle that Spark leaves out would have every reader make the lines again
    assert rows(held) == rows(lines) and rows(again) == rows(marked)
    facts = resume_checks.facts(cvs, "id", "cv", 24300)._jdf.queryExecution().executedPlan().toString()
    assert facts.count("REPARTITION_BY_NUM") > 3


def test_lines_of_yaml_carry_no_steps(spark):
    from textloom.operators import json_yaml

    doc = '[[{"a":[[],{"b":1,"c":[2]}]},3],{"d":{"e":[[4]]}},{}]'
    df = json_yaml.to_yaml(spark.createDataFrame([(1, doc)], "id int, doc string"), "id", "doc")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "steps" not in plan and "nth" not in plan
    assert df.first().output == "- - a:\n      - []\n      - b: 1\n        c:\n          - 2\n  - 3\n- d:\n    e:\n      - - 4\n- {}\n"
