"""Matches, order, placeholder text, sealed texts, JSON tables and types, streams: against other means."""

import hashlib
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import numeric, placeholder, tokens
from textloom.operators import delimited, diff, frequency, json_yaml, lines, matches, relations, render
from textloom.operators import resume_checks as checks
from textloom.operators import json_tables as J
from textloom.streaming import windows


def col(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


# ---- matches

TEXTS = ["ab\ncd", "axxb", "", "\n\n", "no", "The the\nTHE end", "a" * 700 + "\n" + "xb" * 300, "é😀x\nx", None]


@pytest.mark.parametrize(("pattern", "flags", "groups"), [("^|b", "gm", 0), ("x*", "g", 0), (r"(?<![a-z])(?=[a-z])|(?<=[a-z])(?![a-z])", "g", 0), ("the", "gi", 0), ("the", "i", 0), ("(x)|(b)", "g", 2), ("$", "gm", 0), ("c.d|b.c", "gs", 0), ("(?<one>[a-z])(x)?", "g", 2), ("q", "g", 0)])
def test_places_of_matches(spark, pattern, flags, groups):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    got = {(r.k, r.n): (r["index"], r.line, r.column, r.match, r.captures) for r in matches.find_all(df, "k", "t", pattern, groups, flags).collect()}
    want = {}
    compiled = re.compile(pattern.replace("(?<one>", "(?P<one>"), re.I * ("i" in flags) | re.M * ("m" in flags) | re.S * ("s" in flags))
    for k, t in enumerate(TEXTS):
        at, n = 0, 0
        while t is not None and at <= len(t) and (m := compiled.search(t, at)):
            n += 1
            before = t[: m.start()]
            want[k, n] = (m.start(), before.count("\n") + 1, m.start() - (before.rfind("\n") + 1) + 1, m[0], [g or "" for g in m.groups()])
            at = m.end() + (m.end() == m.start())
            if "g" not in flags:
                break
    assert got == want


def test_matches_need_a_pattern(spark):
    df = spark.createDataFrame([(1, "abc")], "k int, t string")
    assert matches.find_all(df, "k", "t", "").collect() == []
    assert [r.n for r in matches.find_all(df, "k", "t", ".", limit=2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        matches.find_all(df, "k", "t", "a", flags="gy")


# ---- order


def test_dictionary_order(spark):
    text = "b\na\ná\nB\nA\nz\né\nitem 10\nitem 9\n-a\nÄpfel\nZebra"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    order = lambda mode, **more: [r.line for r in lines.sort_lines(df, "k", "t", mode, **more).orderBy("place").collect()]
    assert order("alpha") == ["-a", "a", "A", "á", "Äpfel", "b", "B", "é", "item 9", "item 10", "z", "Zebra"]
    assert order("alpha", case_sensitive=True)[:6] == ["-a", "a", "A", "á", "Äpfel", "b"]
    assert order("alpha-desc")[0] == "Zebra" and order("length")[:8] == ["a", "A", "á", "b", "B", "é", "z", "-a"]
    assert order("numeric") == ["item 9", "item 10", "-a", "a", "A", "á", "Äpfel", "b", "B", "é", "z", "Zebra"]


# ---- placeholder text


class Plain:
    """The generator and the sentences, number by number."""

    def __init__(self, seed):
        h = 0x811C9DC5
        units = seed.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h ^ int.from_bytes(units[i : i + 2], "little")) * 0x01000193 & 0xFFFFFFFF
        self.a = h

    def __call__(self):
        self.a = self.a + 0x6D2B79F5 & 0xFFFFFFFF
        t = (self.a ^ self.a >> 15) * (self.a | 1) & 0xFFFFFFFF
        t ^= t + (t ^ t >> 7) * (t | 61) & 0xFFFFFFFF
        return (t ^ t >> 14) / 2**32

    def sentence(self, flavour, least=6, most=18):
        pool, (full, comma) = placeholder.WORDS[flavour], placeholder.STOPS[flavour]
        n = least + int(self() * (most - least + 1))
        said = [pool[int(self() * len(pool))] for _ in range(n)]
        if n > 10 and self() > 0.45:
            said[3 + int(self() * (n - 6))] += comma
        text = placeholder.JOINERS[flavour].join(said)
        return (text[0].upper() + text[1:] if flavour in ("classic", "english") else text) + full


def test_the_generator_against_plain_arithmetic(spark):
    seeds = ["", "a", "seed", "Ünï", "漢字", "😀 two", "part 17"]
    hashed = col(spark, seeds, placeholder.seed_of)
    assert hashed == [Plain(s).a for s in seeds]
    assert hashed[1] == 0xE40C292C  # the published value of FNV-1a for "a"
    drawn = col(spark, seeds, lambda c: F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: placeholder.random(placeholder.seed_of(c), i)))
    for s, got in zip(seeds, drawn, strict=True):
        r = Plain(s)
        assert got == [r() for _ in range(41)]


@pytest.mark.parametrize("flavour", list(placeholder.WORDS))
def test_placeholder_text(spark, flavour):
    seeds = ["x", "another", "  spaced  "]
    sentences = col(spark, seeds, lambda c: placeholder.blocks(c, "sentences", 5, flavour))
    paragraphs = col(spark, seeds, lambda c: placeholder.blocks(c, "paragraphs", 2, flavour))
    listed = col(spark, seeds, lambda c: placeholder.blocks(c, "list", 3, flavour))
    words = col(spark, seeds, lambda c: placeholder.blocks(c, "words", 4, flavour))
    space = placeholder.JOINERS[flavour]
    for k, s in enumerate(seeds):
        r = Plain(s.strip())
        assert sentences[k] == [r.sentence(flavour) for _ in range(5)]
        r = Plain(s.strip())
        assert paragraphs[k] == [space.join(r.sentence(flavour) for _ in range(3 + int(r() * 4))) for _ in range(2)]
        r = Plain(s.strip())
        assert listed[k] == [re.sub("[.。।]$", "", r.sentence(flavour, 3, 8)) for _ in range(3)]
        r, pool = Plain(s.strip()), placeholder.WORDS[flavour]
        said = space.join(pool[int(r() * len(pool))] for _ in range(4))
        assert words[k] == [(said[0].upper() + said[1:] if flavour in ("classic", "english") else said) + placeholder.STOPS[flavour][0]]


def test_placeholder_formats(spark):
    b = ['A <b> & {c} "d".', "Two."]
    form = lambda unit, f: col(spark, [b], lambda c: placeholder.formatted(c, unit, f), "array<string>")[0]
    assert form("list", "plain") == "\n".join(b) and form("sentences", "markdown") == "\n\n".join(b) and form("list", "markdown") == "- " + "\n- ".join(b)
    assert form("sentences", "html") == '<p>A &lt;b&gt; &amp; {c} "d".</p>\n<p>Two.</p>' and form("sentences", "jsx").startswith("<p>A &lt;b&gt; &amp; c ")
    assert form("list", "html") == '<ul>\n  <li>A &lt;b&gt; &amp; {c} "d".</li>\n  <li>Two.</li>\n</ul>' and form("list", "array") == '[\n  "A <b> & {c} \\"d\\".",\n  "Two.",\n]'
    assert col(spark, ["s"], lambda c: placeholder.blocks(c, "sentences", 1, start_with_lorem=True))[0][0].startswith(placeholder.OPENING + " ")


def test_placeholder_texts_are_whole(spark, tmp_path):
    from textloom.plans.catalog import QUERIES

    many = col(spark, ["x", None, "y z"], lambda c: placeholder.blocks(c, "sentences", 250, "english"))
    r = Plain("x")
    assert many[0] == [r.sentence("english") for _ in range(250)] and many[1] is None and len(many[2]) == 250
    assert col(spark, [None], lambda c: placeholder.blocks(c)) == [None]
    opened = col(spark, ["x"], lambda c: placeholder.blocks(c, "sentences", 2, start_with_lorem=True))[0]
    r = Plain("x")
    first = r.sentence("classic")
    assert opened == [f"{placeholder.OPENING} {first[0].lower()}{first[1:]}", r.sentence("classic")]
    spark.createDataFrame([(k, f"part {k % 7}") for k in range(3000)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    for row in QUERIES["placeholder_texts"](spark, str(tmp_path)).where("p_partkey % 250 = 3").collect():
        for flavour, space in placeholder.JOINERS.items():
            r = Plain(f"part {row.p_partkey % 7}-{row.p_partkey}")
            said = [space.join(r.sentence(flavour) for _ in range(3 + int(r() * 4))) for _ in range(3)]
            assert row[flavour] == "\n".join(f"<p>{p}</p>" for p in said)


# ---- sealed texts


def test_sealed_texts_keep_their_own_salt(spark):
    rows = spark.createDataFrame([(i, t, hashlib.md5(bytes([i % 2])).digest()) for i, t in enumerate(["secret", "", "naïve 😀 " * 40, None])], "i int, t string, s binary")
    sealed = tokens.encrypt(rows, "t", "a long passphrase", F.col("s"), rounds=1000).cache()
    made = {r.i: r.t for r in sealed.collect()}
    assert made[3] is None and max(map(len, made[2].split("\n"))) == 76 and not made[2].endswith("\n")
    import base64

    assert base64.b64decode(made[0])[:17] == b"\x01" + hashlib.md5(b"\x00").digest()
    opened = {r.i: (r.t, r.error) for r in tokens.decrypt(sealed, "t", "a long passphrase", rounds=1000).collect()}
    assert opened == {0: ("secret", None), 1: ("", None), 2: ("naïve 😀 " * 40, None), 3: (None, None)}
    assert {r.error for r in tokens.decrypt(sealed.where("i < 3"), "t", "another phrase", rounds=1000).collect()} == {"failed"}
    url = made[0].replace("+", "-").replace("/", "_").rstrip("=")
    bad = spark.createDataFrame([(0, url), (1, "!!"), (2, "AQID"), (3, base64.b64encode(b"\x02" + bytes(60)).decode()), (4, made[0][:-8] + "AAAAAAA=")], "i int, t string")
    got = {r.i: (r.t, r.error) for r in tokens.decrypt(bad, "t", "a long passphrase", rounds=1000).collect()}
    assert got[0] == ("secret", None) and [got[i][1] for i in (1, 2, 3)] == ["not base64", "too short", "version 2"] and got[4][0] is None
    sealed.unpersist()
    with pytest.raises(ValueError):
        tokens.encrypt(rows, "t", "short")


def test_a_key_is_derived_once_a_salt(spark):
    rows = spark.createDataFrame([(bytes([i % 3]) * 16,) for i in range(50)] + [(None,), (b"short",)], "salt binary")
    got = {bytes(r.salt): bytes(r.key) for r in tokens.derived_keys(rows, "passphrase", rounds=10).collect()}
    assert got == {bytes([i]) * 16: hashlib.pbkdf2_hmac("sha256", b"passphrase", bytes([i]) * 16, 10) for i in range(3)}


def test_sealing_with_one_salt_for_the_table(spark):
    out = tokens.decrypt(tokens.encrypt(spark.createDataFrame([(1, "x"), (2, "y")], "i int, t string"), "t", "passphrase"), "t", "passphrase")
    assert sorted((r.i, r.t) for r in out.collect()) == [(1, "x"), (2, "y")]


# ---- JSON tables and types

NESTED = '{"meta":{"k":1.50},"items":[{"id":1,"a b":{"x":"q","y":null},"tags":["p",null,{"z":1e3}],"e":{},"c.d":2}, 5, {"late": true, "tags": []}, [1,[2]]]}'


def table(spark, text, **options):
    cells = J.cells(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", J.TableOptions(**options))
    heads = {r.k: r.columns for r in J.header(cells, "k").collect()}.get(1, [])
    return [dict(zip(heads, r.cells, strict=True)) for r in J.rows(cells, "k").orderBy("record").collect()]


def test_json_tables(spark):
    first = table(spark, NESTED)
    assert list(first[0]) == ["id", "a b.x", "a b.y", "tags[0]", "tags[1]", "tags[2].z", "e", "c.d", "value", "late", "tags", "[0]", "[1][0]"]
    assert first[0]["tags[2].z"] == "1000" and first[1]["value"] == "5" and first[2]["late"] == "true" and first[3]["[1][0]"] == "2" and first[0]["late"] == ""
    joined = table(spark, NESTED, arrays="join", separator="_", join_with=";", null_as="NULL")
    assert joined[0]["tags"] == 'p;NULL;{"z":1000}' and joined[0]["a b_y"] == "NULL" and joined[3][""] == "1;[2]" and joined[2]["tags"] == ""
    whole = table(spark, NESTED, arrays="json")
    assert whole[0]["tags"] == '["p",null,{"z":1000}]' and whole[0]["e"] == "{}" and whole[2]["tags"] == "[]"
    assert table(spark, "7") == [{"value": "7"}] and table(spark, "[]") == [] and table(spark, "bad") == [] and table(spark, None) == []
    assert table(spark, '{"x":[],"y":[1]}') == [{"x": "", "y[0]": "1"}]
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"b":[{"c":2},{"a":"z"}]}')], "k int, t string")
    out = J.wide(J.cells(df, "k", "t"), "k").orderBy("k", "record")
    assert out.columns == ["k", "record", "a", "c"] and [tuple(r) for r in out.collect()] == [(1, 0, "1", ""), (2, 0, "", "2"), (2, 1, "z", "")]
    with pytest.raises(ValueError):
        J.wide(J.cells(df, "k", "t"), "k", most=1)


@settings(deadline=None, max_examples=300)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_read_back(x):
    assert float(J.number_text(repr(x))) == x


def test_numbers_as_browsers_write_them():
    written = {"1.50": "1.5", "1e3": "1000", "12345678901234567890": "12345678901234567000", "1e21": "1e+21", "1e-7": "1e-7", "0.000001": "0.000001", "-0.0": "0", "100": "100", "1.5e300": "1.5e+300", "123456789.123": "123456789.123", "-2.50e-9": "-2.5e-9", "5e-324": "5e-324", "0.1": "0.1"}
    assert {k: J.number_text(k) for k in written} == written


def types(spark, text, **options):
    return J.declarations(J.shapes(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t"), "k", J.TypeOptions(**options)).first()


def test_types(spark):
    text = '{"users":[{"name":"a","address":{"city":"x"}},{"name":null,"billing":{"city":"y"},"tags":[1,"2"]}],"Map":{"a-b":{}},"addresses":[{"no":1}],"entries":[{"no":1}],"data":[[{"q":true}]]}'
    got = types(spark, text)
    assert got.code == (
        "export interface Root {\n  users: User[];\n  Map: MapType;\n  addresses: Address2[];\n  entries: Address2[];\n  data: DataItemItem[][];\n}\n\n"
        "export interface Address {\n  city: string;\n}\n\n"
        "export interface User {\n  name: string | null;\n  address?: Address;\n  billing?: Address;\n  tags?: (number | string)[];\n}\n\n"
        'export interface AB {\n  [key: string]: unknown;\n}\n\nexport interface MapType {\n  "a-b": AB;\n}\n\n'
        "export interface Address2 {\n  no: number;\n}\n\nexport interface DataItemItem {\n  q: boolean;\n}\n"
    )
    assert (got.types, got.optional, got.unions) == (7, 3, 2)
    inline = types(spark, '{"a":{"b":[]},"c":{}}', nested="inline", style="type", unknown="any", readonly=True)
    assert inline.code == "export type Root = {\n  readonly a: {\n    readonly b: any[];\n  };\n  readonly c: Record<string, any>;\n};\n"
    assert types(spark, '[1,null,"x"]', root="list of things").code == "export type ListOfThings = (number | string | null)[];\n"
    assert types(spark, '[{"a":1},{"b":2}]', optional=False, root="items").code.startswith("export interface Item {\n  a: number;\n  b: number;\n}")
    assert types(spark, "not json") is None


# ---- streams


def replay(spark, tmp_path, batches, schema, run, name):
    """Each batch is one file and one micro-batch; the rows that came out, and the state's rows after each."""
    src, out = tmp_path / f"{name}-in", f"{name}_out"
    src.mkdir()
    df = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    query, state = None, []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
        part = next((tmp_path / f"{name}-{i}").glob("part-*.parquet"))
        part.rename(src / f"{i:03d}.parquet")
        query = query or df.writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
        query.processAllAvailable()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    query.stop()
    return spark.table(out).collect(), state


def test_rate_limit_by_event_time_gives_the_batch_rows(spark, tmp_path):
    import datetime as dt
    import random

    random.seed(4)
    zero = dt.datetime(2026, 1, 1)
    rows = [(f"k{random.randrange(3)}", zero + dt.timedelta(seconds=random.choice([0, 0.5, 1]) + 20 * i + random.randrange(-100, 100))) for i in range(150)]
    rows += [rows[-1], rows[-1]]
    batches = [rows[i : i + 30] for i in range(0, len(rows), 30)]  # out of order, within and across batches
    last = [("end", zero + dt.timedelta(days=1))]
    too_late = [("k0", zero - dt.timedelta(days=3)), ("end", zero + dt.timedelta(days=1, seconds=1))]
    got, state = replay(spark, tmp_path, [*batches, last, too_late, [("end", zero + dt.timedelta(days=2))]], "k string, ts timestamp", lambda s: windows.rate_limit_stream(s, "k", "ts", 120, 4), "hits")
    df = spark.createDataFrame(rows + last, "k string, ts timestamp")
    want = sorted((r.k, r.ts, r.hits, r.limited) for r in windows.rate_limit(df, "k", "ts", 120, 4).collect())
    assert sorted((r.k, r.ts, r.hits, r.limited) for r in got if r.k != "end" or r.ts == last[0][1]) == want
    assert any(x[3] for x in want) and max(state) >= 3 and state[-1] <= 1


def test_usage_windows_close_after_the_watermark(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [(at(m), "ab"[m % 2], float(m)) for m in range(0, 200, 7)]
    batches = [rows[::2], rows[1::2], [(at(600), "a", 1.0)], [(at(1), "a", 99.0), (at(900), "a", 1.0)]]  # the last has a row too late to count
    schema = "ts timestamp, kind string, v double"
    got, state = replay(spark, tmp_path, batches, schema, lambda s: windows.usage_by_window(s, "ts", "kind", "v", late="4 hours"), "usage")
    want = {tuple(r) for r in windows.usage_by_window(spark.createDataFrame(rows + batches[2], schema), "ts", "kind", "v").collect()}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and state[-1] < max(state)


def test_first_answers_of_a_stream(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    batches = [[(1, at(0)), (1, at(1)), (2, at(2))], [(1, at(3)), (3, at(30))], [(4, at(600))], [(5, at(700))]]
    got, state = replay(spark, tmp_path, batches, "k int, ts timestamp", lambda s: windows.first_answers(s, ["k"], "ts", late="1 hour"), "answers")
    assert sorted(r.k for r in got) == [1, 2, 3, 4, 5] and state[-1] < 4


def test_json_texts_of_odd_kinds(spark):
    df = spark.createDataFrame([(1, '"x\\"y"'), (2, "null"), (3, "1.0"), (4, '{"a":[{"b":1}],"a b":null}')], "k int, t string")
    got = {r.k: (r.n_bytes, r.minified_bytes, r.depth, r.keys, r.root) for r in J.stats(df, "k", "t").collect()}
    assert got == {1: (6, 6, 1, 0, "string"), 2: (4, 4, 1, 0, "null"), 3: (3, 1, 1, 0, "number"), 4: (26, 26, 4, 3, "object")}
    assert json.loads('"x\\"y"') == 'x"y'


# ---- YAML

VALUES = [
    {"b": [1, 2.5, {"c": None}], "a": "x\ny\n"},
    [],
    {"k: v": "yes", "n": "1.20", "e": "", "t": " x", "m": "a\n\nb", "q": "it's", "z": [[1], {"a": []}], "c": "a: b #c", "u": "ü 漢"},
    "alone",
    True,
    {"deep": {"er": {"list": ["-", "- x", "~", "null", "0x1f", "12:30", [[[{"p": [{"q": 1, "r": 2}, 3]}]]]]}}, "ctl": "a\tb\x01 \"\\", "x:y": 3},
    {"tail": "two\n\n", "none": {}, "yes": 1, "sp": "a \nb"},
    {},
    [[[]], [{}], {"l": [{"m": {"n": [1]}}]}],
]


@pytest.mark.parametrize("options", [json_yaml.YamlOptions(), json_yaml.YamlOptions(indent=4), json_yaml.YamlOptions(quote="single"), json_yaml.YamlOptions(quote="double", document_start=True), json_yaml.YamlOptions(blocks=False), json_yaml.YamlOptions(sort_keys=True)])
def test_yaml_reads_back(spark, options):
    yaml = pytest.importorskip("yaml")
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(99, "bad"), (98, None)], "k int, t string")
    got = {r.k: r.output for r in json_yaml.to_yaml(rows, "k", "t", options).collect()}
    assert set(got) == set(range(len(VALUES)))
    for i, v in enumerate(VALUES):
        assert yaml.safe_load(got[i]) == v, got[i]


def test_yaml_layout(spark):
    rows = spark.createDataFrame([(1, json.dumps({"items": [{"id": 1, "tags": ["a", [2, 3]]}, []], "note": "one\ntwo", "no": "yes", "x:y": "1.0"})), (2, '{"b":1,"B":2,"a":[{"d":1,"c":2}]}')], "k int, t string")
    got = {r.k: r for r in json_yaml.to_yaml(rows, "k", "t").collect()}
    assert got[1].output == "items:\n  - id: 1\n    tags:\n      - a\n      - - 2\n        - 3\n  - []\nnote: |-\n  one\n  two\n'no': 'yes'\n'x:y': '1.0'\n"
    assert (got[1].n_lines, got[1].quoted, got[1].blocks, got[1].ambiguous, got[1].depth) == (12, 2, 1, ["yes", "1.0"], 5)
    ordered = json_yaml.to_yaml(rows.where("k = 2"), "k", "t", json_yaml.YamlOptions(sort_keys=True, indent=4, document_start=True)).first().output
    assert ordered == "---\na:\n    -   c: 2\n        d: 1\nb: 1\nB: 2\n"


# ---- characters, links, phrases


def test_classes_of_graphemes(spark):
    texts = ["aé1 .+", "e\u0301x", "👍🏽👩‍👩‍👧 ©", "漢字\n\t", "\u0000\u0301", "", None]
    got = [r.asDict() for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *(c.alias(n) for n, c in frequency.grapheme_classes(F.col("t")).items())).orderBy("i").collect()]
    names = ("emoji", "letters", "digits", "whitespace", "punctuation", "symbols", "other")
    assert [tuple(r[n] for n in names) for r in got] == [(0, 2, 1, 1, 1, 1, 0), (0, 2, 0, 0, 0, 0, 0), (3, 0, 0, 1, 0, 0, 0), (0, 2, 0, 2, 0, 0, 0), (0, 0, 0, 0, 0, 0, 2), (0,) * 7, (None,) * 7]


def test_phrases_in_texts(spark):
    rows = [("We use C++ and node.js, daily reports", "c++", True), ("x report y", "reports", True), ("x reports y", "report", True), ("micro-services", "services", True), ("microservices", "services", False), ("a.b", "a", True), ("", "a", False), (None, "a", None)]
    got = spark.createDataFrame(rows, "t string, p string, want boolean").select("want", relations.phrase_present(F.col("t"), F.col("p")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_places_of_errors_in_json(spark):
    bad = {1: "{'a': 1}", 2: '{"a": 1,}', 3: '{"a": 1,\n b: 2}', 4: '{"a": [1, 2', 5: '{"a": NaN}', 6: '[1,\n 2,\n]', 7: "", 8: '{"k": "' + "x" * 300 + '" 1}'}
    rows = spark.createDataFrame([*bad.items(), (20, "[1]"), (21, None)], "k int, t string")
    got = {r.k: r for r in render.diagnose(rows, "k", "t").collect()}
    assert set(got) == set(bad)
    assert [(got[i].line, got[i].column) for i in (1, 2, 3, 5, 6)] == [(1, 2), (1, 9), (2, 2), (1, 7), (3, 1)]
    assert [next(k for k, h in render.HINTS.items() if h == got[i].hint) for i in range(1, 8)] == ["quotes", "comma", "word", "end", "number", "comma", "end"]
    assert got[3].excerpt == " b: 2}" and got[3].pointer == " ^" and len(got[8].excerpt) == 121


def test_delimited_tables(spark):
    rows = delimited.parse(spark.createDataFrame([(1, "a, b\n\n1 ,2\n3,4,5"), (2, "x")], "k int, t string"), "k", "t")
    got = [(r.k, r.row_no, r.names, r.cells) for r in delimited.table_rows(rows, "k").orderBy("k", "row_no").collect()]
    assert got == [(1, 1, ["a", "b"], ["1", "2"]), (1, 2, ["a", "b"], ["3", "4", "5"])]
    bare = [(r.k, r.names, r.cells) for r in delimited.table_rows(rows, "k", with_header=False, trim=False).orderBy("k", "row_no").collect()]
    assert bare[0] == (1, ["Column 1", "Column 2"], ["a", " b"]) and bare[-1] == (2, ["Column 1"], ["x"])


def test_what_a_review_is_given(spark):
    cv = "Ada\nada@x.org +44 20 7946 0958, 020.794.6095\nExperience\nLead, 2001 - 2004\n• Responsible for 5 reports\n• Built 3 sites\n• Nothing in numbers"
    df = spark.createDataFrame([(1, cv), (2, None)], "k int, t string")
    terms = spark.createDataFrame([(1, f"t{i}", i, i % 2 == 0) for i in range(60)], "k int, term string, place int, present boolean")
    found = spark.createDataFrame([(1, f"c{i}", ["polish", "critical"][i % 2], float(i)) for i in range(20)], "k int, check string, severity string, points_lost double")
    got = {r.k: r for r in checks.review_payload(df, "k", "t", 24317, found, terms).collect()}
    assert "@" not in got[1].cv and got[1].cv.count("[phone removed]") == 2
    assert got[1].weak_bullets == ["Responsible for 5 reports", "Nothing in numbers"] and got[1].missing_terms == [f"t{i}" for i in range(1, 40, 2)]
    assert got[1].issues[:2] == ["c19", "c17"] and len(got[1].issues) == 14 and got[2].issues == [] and got[2].cv is None


def test_differences_of_bags(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 1, 2], [1, 3, 3]))
    assert sorted((r.kind, r.x) for r in diff.multiset_diff(a, b).collect()) == [("added", 3), ("added", 3), ("removed", 1), ("removed", 2)]


def test_bits_of_entropy(spark):
    import math

    got = col(spark, ["abc", "aB1!", "", "zzzz 1"], numeric.entropy_bits)
    want = [3 * math.log2(26), 4 * math.log2(26 + 26 + 10 + 25), 0, 6 * math.log2(26 + 10 + 25)]
    assert got == [round(x, 1) for x in want]
