"""Operators on small inputs whose results are worked out by hand, by Python, or by a published vector."""

import base64
import hashlib
import hmac as std_hmac
import json
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.functions import dates, encoding, numeric, tokens, web
from textloom.functions import text as T
from textloom.operators import delimited, diff, jsons, lines, relations, resume
from textloom.operators import resume_checks as checks
from textloom.sources import pdf
from textloom.streaming import windows


def col(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_cases(spark):
    titles = ["the lord of the rings", "a tale of two cities", "what to look for in", ""]
    assert col(spark, titles, T.title_case) == ["The Lord of the Rings", "A Tale of Two Cities", "What to Look for In", ""]
    assert col(spark, ["parseHTMLText now"], lambda c: T.programmer_case(c, "camel")) == ["parseHtmlTextNow"]
    assert col(spark, ["aB1 c"], T.toggle_case) == ["Ab1 C"]


def test_slugs(spark):
    names = ["How to compress a PDF without losing quality!", "Café Münster — a review", "10 Best Tools for Developers in 2026", "Straße & Weg: ein Führer"]
    assert col(spark, names, lambda c: T.slugify(c)) == ["how-to-compress-a-pdf-without-losing-quality", "cafe-munster-a-review", "10-best-tools-for-developers-in-2026", "strasse-weg-ein-fuhrer"]
    assert col(spark, ["the of and"], lambda c: T.slugify(c, stop_words=True)) == ["the-of-and"]


def test_line_operators(spark):
    rows = spark.createDataFrame([(1, "a\nb\nA"), (2, None), (3, "")], "k int, t string")
    last = sorted(map(tuple, lines.dedupe_lines(rows, "k", "t", keep="last").collect()))
    assert last == [(1, 0, "A"), (1, 1, "b"), (3, 0, "")]
    numbered = col(spark, ["x\n\ny", "\n".join("abcdefghij")], lines.number_lines)
    assert numbered[0] == "1. x\n\n2. y" and numbered[1].startswith("01. a\n02. b") and numbered[1].endswith("10. j")
    shown = ["1. const x = 1", "42: y", "7) z", "128 | w", "15\tv", "  9  u", "const x = 1  // 15"]
    assert col(spark, shown, lambda c: lines.strip_line_numbers(c)[0]) == ["const x = 1", "y", "z", "w", "v", "u", "const x = 1  // 15"]
    items = spark.createDataFrame([(1, "x\n2\n10")], "k int, t string")
    assert [r.line for r in lines.sort_lines(items, "k", "t", "numeric-desc").orderBy("place").collect()] == ["10", "2", "x"]
    assert col(spark, ["a\r\nb\rc\nd", "a", "a\r\nb"], T.line_ending) == ["mixed", "none", "crlf"]


def test_rounding_and_percent(spark):
    assert col(spark, [-2.5, 2.5, 0.125], lambda c: T.half_up(c), "double") == [-2.0, 3.0, 0.0]
    assert col(spark, [200.0], lambda c: numeric.percent("of", F.lit(15.0), c), "double") == [30.0]
    assert col(spark, [5.0, 0.0], lambda c: numeric.percent("change", c, F.lit(6.0)), "double") == [20.0, None]
    assert col(spark, [1234.5, 0.0, float("inf")], numeric.number_format, "double") == ["1,234.5", "0", "—"]
    assert col(spark, [100, 2048, 5 << 20], numeric.byte_format, "long") == ["100 B", "2.0 KB", "5.00 MB"]


def test_encodings(spark):
    words = ["", "Hello, wörld ~ a+b!", "ÿÿ>>??" * 40]
    assert col(spark, words, encoding.base64) == [base64.b64encode(w.encode()).decode() for w in words]
    assert col(spark, words, lambda c: encoding.unbase64(encoding.base64(c, url_safe=True))) == words
    assert col(spark, ["abcde", "@@@@"], encoding.unbase64) == [None, None]
    assert col(spark, ["QUJD", "QUJDx", "a b", ""], encoding.looks_like_base64) == [True, False, True, False]
    assert col(spark, [words[1]], lambda c: encoding.url_encode(c)) == ["Hello%2C%20w%C3%B6rld%20~%20a%2Bb!"]
    assert col(spark, ["https://x.y/a b?c=d&e#f"], lambda c: encoding.url_encode(c, "full")) == ["https://x.y/a%20b?c=d&e#f"]
    assert col(spark, ["a+b%20c", "%zz"], encoding.url_decode) == ["a+b c", None]
    for bits, name in ((1, "sha1"), (256, "sha256"), (384, "sha384"), (512, "sha512")):
        for secret in ("key", "long " * 50):
            want = [std_hmac.new(secret.encode(), w.encode(), name).hexdigest() for w in words]
            assert col(spark, words, lambda c, s=secret, b=bits: encoding.hmac(c, s, b)) == want
    assert col(spark, ["x"], lambda c: encoding.hmac(c, "")) == [hashlib.sha256(b"x").hexdigest()]


def test_tokens(spark):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode() if isinstance(x, dict) else x).rstrip(b"=").decode()
    body = part({"alg": "HS256"}) + "." + part({"sub": "a", "iat": 1000, "exp": 5000, "password": "x"})
    good = body + "." + part(std_hmac.new(b"secret", body.encode(), "sha256").digest())
    rows = spark.createDataFrame([(0, "Bearer " + good), (1, good[:-2] + "AA"), (2, "a.b"), (3, part({"alg": "none"}) + "." + part({}) + "."), (4, None)], "i int, t string")
    out = {r.i: r for r in tokens.decode_jwt(rows, "t", 4000, secret="secret").collect()}
    assert out[0].status == "valid" and out[0].signature == "valid" and out[0].expires == "in 17 minutes" and out[0].warnings == ["sensitive claims"]
    assert out[1].signature == "invalid" and out[2].error and out[2].status is None
    assert out[3].signature == "unsigned" and "never expires" in out[3].warnings
    late = tokens.decode_jwt(rows.where("i = 0"), "t", 6000).first()
    assert late.status == "expired" and late.signature == "no-secret"


@pytest.mark.parametrize("kind,pattern", [("v4", r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"), ("v7", r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"), ("ulid", r"[0-9A-HJKMNP-TV-Z]{26}"), ("nanoid", r"[A-Za-z0-9_-]{21}")])
def test_identifiers(spark, kind, pattern):
    ids = [r.id for r in tokens.identifiers(spark.range(200), kind, 1_700_000_000_000).collect()]
    assert len(set(ids)) == 200 and all(re.fullmatch(pattern, x) for x in ids)


def test_dates(spark):
    text = "Jan 2019 - March 2021, 2020-05 to 06/2022, 2018 until present"
    assert col(spark, [text], dates.date_tokens) == [["Jan 2019", "March 2021", "2020-05", "06/2022", "2018", "present"]]
    at = lambda y, m: y * 12 + m - 1
    assert col(spark, ["Jan 2019", "2020-05", "06/2022", "2018", "present"], lambda c: dates.month_index(c, 5)) == [at(2019, 1), at(2020, 5), at(2022, 6), at(2018, 1), 5]
    assert col(spark, ["2018"], lambda c: dates.month_index(c, 5, end=True)) == [at(2018, 12)]
    assert col(spark, ["2026-05", "2026-06", "x"], lambda c: dates.stale(c, "2026-12-15")) == [True, False, None]


def test_web(spark):
    assert col(spark, ["github.com/me", "javascript:alert(1)", " HTTP://x.y ", "mailto:a@b.c", ""], web.safe_url) == ["https://github.com/me", None, "HTTP://x.y", "mailto:a@b.c", None]
    assert col(spark, ["https://www.google.com/x", "https://chatgpt.com/", "https://own.org/a", "https://www.reddit.com/", "nothing", None], lambda c: web.referrer_kind(c, "own.org")) == ["search", "ai", "internal", "social", "direct", "direct"]
    assert col(spark, ["n=500&m=b", "n=x", ""], lambda c: web.query_option(c, "n", "number", 5, least=1, most=100)) == [100.0, 5.0, 5.0]
    assert col(spark, ["m=b", "m=z"], lambda c: web.query_option(c, "m", "enum", "a", choices=("a", "b"))) == ["b", "a"]


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 6, 9), ("a", 16, 20), ("b", 0, 5), ("b", 11, 12), ("c", 0, 9), ("c", 2, 3), ("c", 2, 3)], "k string, s int, e int")
    assert sorted(map(tuple, relations.merge_intervals(rows, "k", "s", "e").collect())) == [("a", 15, 2, 1), ("b", 8, 2, 0), ("c", 10, 1, 0)]


def test_related(spark):
    items = spark.createDataFrame([(i, f"c{i % 2}", f"g{i % 3}", 100 - i) for i in range(30)], "id int, cluster string, cat string, rank int")
    links = spark.createDataFrame([(0, 29), (0, 27), (0, 77)], "id int, other int")
    got = [(r.other, r.priority) for r in relations.related(items, links, "id", "cluster", "cat", "rank").where("id = 0").orderBy("place").collect()]
    assert got == [(27, 1), (29, 1), (2, 2), (4, 2), (6, 2), (8, 2), (10, 2), (12, 2)]


def test_json(spark):
    left = '{"a": 1, "b": {"c": [1, 2]}, "d": "x", "g": {"h": 1}, "n": 1.0}'
    right = '{"n": 1.0, "b": {"c": [1, 3, 4]}, "d": 5, "e": null, "a": 1}'
    one, two = (spark.createDataFrame([(1, t)], "k int, t string") for t in (left, right))
    got = sorted((r.path, r.kind, r.left, r.right) for r in jsons.diff(one, two, "k", "t").collect())
    assert got == [("$.b.c[1]", "changed", "2", "3"), ("$.b.c[2]", "added", None, "4"), ("$.d", "type", "x", "5"), ("$.e", "added", None, "null"), ("$.g", "removed", "object", None)]
    bad = spark.createDataFrame([(1, "{"), (2, None), (3, "NaN"), (4, "[]")], "k int, t string")
    assert sorted((r.k, r.type) for r in jsons.nodes(bad, "k", "t").collect()) == [(1, "error"), (3, "error"), (4, "array")]
    s = jsons.stats(one, "k", "t").first()
    assert (s.depth, s["keys"], s.arrays, s.objects, s.nulls, s.root) == (4, 7, 1, 3, 0, "object")


def test_json_shapes(spark):
    text = '{"meta": {"n": 2}, "data": [{"id": 1, "name": "a", "tags": ["x"]}, {"id": 2, "late": true, "name": null}]}'
    shape = {r["shape"]: (r.types, r.n, r.optional) for r in jsons.shape(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()}
    assert shape["$.data[].name"] == (["null", "string"], 2, False) and shape["$.data[].late"] == (["boolean"], 1, True) and shape["$.data[]"] == (["object"], 2, False)


def test_yaml_scalars(spark):
    words = ["1.20", "NO", "off", "yes", "09:30", "sh", "a: b", "", "- x", "v1", "~", "2026-01-02", "key:"]
    assert col(spark, words, jsons.yaml_needs_quotes) == [True, True, True, True, True, False, True, True, True, False, True, True, True]


def test_delimited(spark):
    texts = ['"Rahman, Ayesha",Engineer', '"She said ""hi""",ok', 'a,"multi\nline",c', "a,,c", '"a"b,c', "a,b\r\nc,d\r\n", "", "x,\n"]
    want = [[["Rahman, Ayesha", "Engineer"]], [['She said "hi"', "ok"]], [["a", "multi\nline", "c"]], [["a", "", "c"]], [["ab", "c"]], [["a", "b"], ["c", "d"]], [], [["x", ""]]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got: dict = {i: [] for i in range(len(texts))}
    for r in delimited.parse(rows, "k", "t").orderBy("k", "row_no").collect():
        got[r.k].append(r.cells)
    assert [got[i] for i in range(len(texts))] == want
    found = spark.createDataFrame([(1, "a;b;c\n1;2;3\n4;5;6"), (2, "name\tage\nx\t1\ny"), (3, "one"), (4, ""), (5, 'a,"b,c"\n1,2')], "k int, t string")
    assert sorted((r.k, r.delimiter, round(r.confidence, 2), r.columns) for r in delimited.detect(found, "k", "t").collect()) == [(1, ";", 1.0, 3), (2, "\t", 0.67, 2), (3, ",", 0.0, 0), (4, ",", 0.0, 0), (5, ",", 1.0, 2)]
    ragged = delimited.ragged(delimited.parse(spark.createDataFrame([(1, "a,b\n1,2\n\n3\n4,5,6")], "k int, t string"), "k", "t"), "k").first()
    assert (ragged.n_rows, ragged.width, ragged.n_ragged) == (4, 2, 2)
    assert col(spark, ["=1+1", 'a"b', "-x,y"], lambda c: delimited.csv_row([c], guard=True)) == ["'=1+1", '"a""b"', "\"'-x,y\""]


def test_line_diff(spark):
    import random

    r = random.Random(4)
    pairs = [(i, "\n".join(r.choice("abcd") for _ in range(r.randrange(9))), "\n".join(r.choice("abcd") for _ in range(r.randrange(9)))) for i in range(60)]
    rows = spark.createDataFrame([*pairs, (90, None, "x"), (91, "A  b\nc", "a b\nc")], "k int, l string, r string")
    found: dict = {}
    for x in diff.line_diff(rows, "k", "l", "r").orderBy("k", "pos").collect():
        found.setdefault(x.k, []).append(x)

    def common(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for k, a, b in pairs:
        a, b = a.split("\n"), b.split("\n")
        assert [x.line for x in found[k] if x.kind != "added"] == a and [x.line for x in found[k] if x.kind != "removed"] == b
        assert sum(x.kind == "same" for x in found[k]) == common(a, b)
    folded = diff.diff_stats(diff.line_diff(rows.where("k = 91"), "k", "l", "r", ignore_whitespace=True, ignore_case=True), "k").first()
    assert (folded.added, folded.removed, folded.same) == (0, 0, 2)


def test_rate_limit(spark):
    rows = spark.createDataFrame([("u", 50 * i) for i in range(13)] + [("u", 600), ("v", 0)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.k, r.s): (r.hits, r.limited) for r in windows.rate_limit(rows, "k", "ts").collect()}
    assert got["u", 550] == (12, False) and got["v", 0] == (1, False)
    assert got["u", 600] == (13, True)  # two at 600, none at 0: that one is just too old


CV = """Jane Roe
jane.roe@example.org  +44 20 7946 0958  linkedin.com/in/janeroe

Summary
Engineer who builds reliable data systems.

Experience
Acme, Engineer, Jan 2019 - Dec 2020
• Led a team of 12 people and cut costs by 30%
• Built a pipeline for 40 million rows a day
• Responsible for reports
Other, Analyst, Jan 2022 - present
• Reduced the time of 3 weekly reports by 5 hours

Education
BSc, 2018

Skills
SQL, Python, Spark
"""


def test_resume(spark):
    rows = spark.createDataFrame([(1, CV), (2, "nothing here"), (3, None)], "k int, t string")
    f = checks.facts(rows, "k", "t", 2026 * 12 + 5)
    long = checks.ratios(f, "k")
    r = {(x.k, x.check): x.ratio for x in long.collect()}
    assert all(r[1, c] == 1 for c in ("email", "phone", "profile-link", "core-sections", "roles-dated", "quantified", "headings-detectable"))
    assert r[1, "career-gaps"] == 0.55  # 2021 is missing
    assert (1, "verb-variety") not in r and abs(r[1, "weak-openers"] - (1 - 2.2 / 4)) < 1e-9
    assert r[2, "headings-detectable"] == 0 and r[3, "core-sections"] == 0.25  # a student need not have worked
    s = {x.k: x for x in checks.roll_up(long, "k").collect()}
    assert s[1].score > s[2].score >= s[3].score and set(s) == {1, 2, 3} and s[1].relevance is None
    got = {x.k: x.markdown for x in checks.report(checks.roll_up(long, "k"), checks.findings(long, "k"), "k").collect()}
    assert got[1].startswith(f"# Score {s[1].score} ({s[1].grade})\n\n| Category | Score |") and "- **polish** career-gaps (structure): -0.5" in got[1]
    hints = {x.bullet: x.hints for x in resume.coaching(resume.lines(rows, "k", "t"), "k").collect()}
    assert hints["Responsible for reports"] == ["open with what you did", "say how much"]


def test_scores_by_hand(spark):
    """The roll-up, check by check, in plain Python."""
    import random

    random.seed(5)
    data = [(k, c, random.choice([0.0, 0.25, 0.4, 1.0])) for k in range(40) for c in checks.CHECKS if random.random() < 0.8 and not (k % 4 == 0 and checks.CHECKS[c][0] == "parse" and c != "text-layer")]
    data += [(90, "text-layer", 0.2), (91, "text-layer", 1.0), (92, "jd-coverage", 0.5)]
    got = {r.k: r for r in checks.roll_up(spark.createDataFrame(data, "k int, check string, ratio double"), "k").collect()}
    for k in {k for k, _, _ in data}:
        mine = {c: x for i, c, x in data if i == k}
        part, scopes = {}, {"quality": [0, 0], "relevance": [0, 0]}
        for cat, (weight, scope) in checks.CATEGORIES.items():
            of = {c: v for c, v in checks.CHECKS.items() if v[0] == cat}
            has = [c for c in of if c in mine]
            part[cat] = int(100 * sum(mine[c] * of[c][1] for c in has) / sum(of[c][1] for c in has) + 0.5) if has else 100
            for c in has:
                share = of[c][1] / sum(v[1] for v in of.values()) * weight
                scopes[of[c][3] or scope][0] += mine[c] * share
                scopes[of[c][3] or scope][1] += share
        q = 100 * scopes["quality"][0] / scopes["quality"][1] if scopes["quality"][1] else 0
        cap = 28 if part["parse"] < 25 else 48 if part["parse"] < 50 else 68 if part["parse"] < 70 else 100
        assert got[k].score == int(round(min(q, cap), 9) + 0.5) and [got[k][c] for c in part] == list(part.values())
        want = int(round(100 * scopes["relevance"][0] / scopes["relevance"][1], 9) + 0.5) if scopes["relevance"][1] else None
        assert got[k].relevance == want
    assert got[90].score == 20 and got[91].score == 100 and got[92].score == 0 and got[92].relevance == 50


def test_checks_of_targets_and_layout(spark):
    cv = "Ada Lovelace\nData Engineer\nada@example.com\nExperience\nEngineer, 2001 – 2020\n• Manages 12 people and cut cost 3%\n• Built spark jobs\n• Led sql work at cost 4%\nSkills\nSpark, SQL"
    df = spark.createDataFrame([(1, cv), (2, cv)], "k int, t string")
    fields = spark.createDataFrame([("data", "repository", "projects", ["sql", "spark", "go", "rust"], ["cost"])], "department string, link string, section string, core_skills array<string>, outcome_words array<string>")
    targets = spark.createDataFrame([(1, "Data Engineer", "data"), (2, None, "unknown")], "k int, target_role string, department string")
    adverts = spark.createDataFrame([(1, "sql sql spark spark golang golang engineers engineers and more of it"), (2, "short")], "k int, advert string")
    layout = spark.createDataFrame([(1, 2.0, 900.0, 1, 9, 1, 1, 2, 100)], "k int, pages double, glyphs double, multi_column_pages int, unmapped_glyphs int, hidden_runs int, contact_in_margin int, fonts_not_embedded int, vector_marks int")
    f = checks.facts(df, "k", "t", 2026 * 12 + 5, targets=targets, departments=fields, adverts=adverts, layout=layout)
    r = {(x.k, x.check): round(x.ratio, 4) for x in checks.ratios(f, "k").collect()}
    one = {c: x for (k, c), x in r.items() if k == 1}
    assert (one["single-column"], one["glyph-mapping"], one["hidden-text"], one["contact-in-body"], one["fonts-embedded"], one["table-chrome"]) == (0.175, 0.94, 0, 0.2, 0.5, round(1 - 5 / 180, 4))
    assert (one["headline-matches-role"], one["department-link"], one["department-skills"], one["department-evidence"]) == (1, 0, 1, round(2 / 3, 4))
    assert "department-section" not in one and one["jd-coverage"] == round((3 / 4 - 0.15) / 0.55, 4) if 3 / 4 < 0.7 else one["jd-coverage"] == 1
    assert one["tense-consistency"] == round(1 - 1 / 3 / 0.5, 4) and one["leadership-signal"] == 1 and one["skills-listed"] == 0.25
    two = {c for k, c in r if k == 2}
    assert not two & {"department-link", "department-skills", "department-evidence", "department-section", "jd-coverage", "headline-matches-role"}


def test_roles_and_headings(spark):
    cvs = [
        (1, "Experience\nAnalyst at Initech\n03/2012 - 12/2015\n- did one thing here\nDeveloper | Acme, Paris 2001 to 2003\nprose of a few words"),
        (2, "Career\nno date in this line\nnor in this one here\nSept 2010 – present, Lead"),
        (3, "Lead, 2001 - 2004\nBuilt all of it"),
        (4, "Experienced engineer\nSkillset\nExperience:\nx\nExperience\nReferences"),
        (5, ""),
        (6, None),
    ]
    rows = resume.lines(spark.createDataFrame(cvs, "k int, t string"), "k", "t")
    heads = {k: [x.heading for x in rows.where("heading is not null").orderBy("k", "line_no").collect() if x.k == k] for k in range(1, 7)}
    assert heads == {1: ["experience"], 2: ["experience"], 3: [], 4: ["experience"], 5: [], 6: []}
    out = resume.roles(resume.marked_lines(resume.role_lines(rows, "k", 2026 * 12 + 5), "k"), "k")
    got = {(r.k, r.role_no): r for r in out.collect()}
    a = got[1, 0]
    assert (a.header, a.title, a.organisation, a.dates.months, a.bullets, a.prose_words) == ("Analyst at Initech 03/2012 - 12/2015", "Analyst", "Initech", 46, ["did one thing here"], 0)
    b = got[1, 1]
    assert (b.title, b.organisation, b.dates.raw, b.prose_words) == ("Developer", "Acme, Paris", "2001 to 2003", 5)
    c = got[2, 0], got[2, 1]
    assert c[0].dates is None and c[0].bullets == ["nor in this one here"] and c[1].dates.current and c[1].title == "Lead"
    assert got[3, 0].source == "experience" and got[3, 0].bullets == ["Built all of it"]
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0)}


def test_dates(spark):
    texts = ["Mar-2021 to 2022/05", "3-2021", "1915 - 2090", "2019 to date", "March 2019 – Present", "12021 2021 - 03/2022", "present - 2020", "2019 xx 2020", None, ""]
    tokens = dates.date_tokens(F.col("t"), 2026 * 12 + 5)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.alias("k")).select("k", dates.date_range(F.col("t"), F.col("k")).alias("r")).collect()
    assert [[(x.at, x.year, x.month) for x in r.k or []] for r in got] == [[(0, 2021, 3), (12, 2022, 5)], [(0, 2021, 3)], [], [(0, 2019, None), (5, 2026, 6)], [(0, 2019, 3), (13, 2026, 6)], [(6, 2021, None), (13, 2022, 3)], [(0, 2026, 6), (10, 2020, None)], [(0, 2019, None), (8, 2020, None)], [], []]
    assert [r.r and (r.r.raw, r.r.months, r.r.current) for r in got] == [("Mar-2021 to 2022/05", 15, False), ("3-2021", None, False), None, ("2019", None, False), ("March 2019 – Present", 88, True), ("2021 - 03/2022", 15, False), None, ("2019", None, False), None, None]
    labels = col(spark, [0, 59, 60, 89, 90, 3600], dates.duration_label)
    assert labels == ["0 sec", "59 sec", "1 min", "1 min", "2 min", "60 min"]
    assert col(spark, ["2025-11", "2025-12", "2026-05", "bad"], lambda c: dates.stale(c, "2026-06-15")) == [True, False, False, None]


def test_base_verbs(spark):
    forms = {"led": "lead", "managed": "manage", "planning": "plan", "simplified": "simplify", "builds": "build", "achieves": "achieve", "coaches": "coach", "running": "run", "assessed": "assess", "found": None, "responsible": None, "cut": "cut", "designing": "design", "writing": "write", "": None}
    got = spark.createDataFrame([(w,) for w in forms], "w string").select("w", resume.base_verb(F.col("w")).alias("v")).collect()
    assert {r.w: r.v for r in got} == forms


def test_pdf(spark, tmp_path):
    content = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) 20 (ld) -300 (again)] TJ ET\nBT /F1 12 Tf 1 0 0 1 72 600 Tm <4869> Tj ET"
    obj = lambda data, head=b"": b"1 0 obj << /Length %d %s>>\nstream\n%s\nendstream\nendobj\n" % (len(data), head, data)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n" + obj(content))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\n" + obj(zlib.compress(content), b"/Filter /FlateDecode "))
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    runs = pdf.read_runs(spark, str(tmp_path))
    errors = [r.path for r in runs.where("error is not null").collect()]
    assert len(errors) == 1 and errors[0].endswith("c.pdf")
    got = {r.path[-5:]: r.text for r in pdf.texts(pdf.page_lines(runs)).collect()}
    assert got == {"a.pdf": "Hello (PDF)\nworld again\n\nHi", "b.pdf": "Hello (PDF)\nworld again\n\nHi"}


def test_rewritten_json(spark):
    values = [{"b": [1, 2.50, {"c": None}], "a": "x\ny\n"}, [], {"k: v": "yes", "n": "1.20", "e": "", "t": " x", "m": "a\n\nb", "q": "it's", "z": [[1], {"a": []}], "c": "a: b #c", "u": "ü 漢"}, "alone", True, {"deep": {"er": {"list": ["-", "- x", "~", "null", "0x1f", "12:30"]}}, "ctl": "a\tb\x01"}, {"tail": "two\n\n"}]
    texts = [json.dumps(v, ensure_ascii=False) for v in values] + ["{", '{"n": 1.0, "big": 12345678901234567890, "e": 1e3}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    from textloom.operators import render

    for f in (render.beautify, render.minify):
        out = {r.k: r for r in f(rows, "k", "t").collect()}
        assert [json.loads(out[i].output) for i in range(len(values))] == values
        assert out[len(values)].output is None and out[len(values)].error.startswith("line 1")
    assert out[len(values) + 1].output == '{"n":1.0,"big":12345678901234567890,"e":1e3}'


def test_more_cases(spark):
    assert col(spark, ["HELLO there. how ARE\nyou? fine", ""], T.sentence_case) == ["Hello there. How are\nYou? Fine", ""]
    assert col(spark, ["hello, world"], T.alternating_case) == ["hElLo, WoRlD"]
    assert col(spark, ["• one", "2) two", "(3) three", "- four", "five"], T.strip_bullet) == ["one", "two", "three", "four", "five"]
