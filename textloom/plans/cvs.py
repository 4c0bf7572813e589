"""Queries over CVs, one for each customer: made by one SQL expression that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import STOP_WORDS
from ..operators import resume
from ..operators import resume_checks as checks
from .registry import query, spread, table

NOW = 2026 * 12 + 5  # June 2026


def _case(n: int, *values: str) -> str:
    """The value for the key modulo n."""
    return f"CASE c_custkey % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


def _year(first: int, span: int) -> str:
    return f"CAST({first} + c_custkey % {span} AS STRING)"


_KEY = "CAST(c_custkey AS STRING)"
_LF = "chr(10)"
_PHONE = "'+44 20 7946 0' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')"
#: Lines of a CV; null where a CV has none.
_LINES = (
    _case(5, "'Ada Lovelace'", "'GRACE B. HOPPER'", "'Jean de la Cour'", "'cv no. 7'", f"'Customer ' || {_KEY}"),
    _case(3, "'Senior Analyst in ' || lower(c_mktsegment)", "NULL", "'http://example.org'"),
    _case(4, f"'ada.' || {_KEY} || '@example.com | ' || {_PHONE} || ' | Lyon, France'", f"'linkedin.com/in/ada-' || {_KEY} || ' and ' || {_PHONE}", "'github.com/grace, grace.dev'", "'Date of birth: 1 May 1980, married'"),
    _case(3, "'SUMMARY'", "'Professional summary:'", "NULL"),
    "'Team player with a proven track record of ' || c_mktsegment || ' results.'",
    _case(7, "'Experienced engineer'", "'Skillset'", "NULL"),
    _case(6, "'Work Experience'", "'EXPERIENCE 2001-2020'", "'Career history -'", "'Employment'", "'My journey'", "'Experience'"),
    _case(
        8,
        f"'Senior Engineer - Acme, Inc | March ' || {_year(1990, 30)} || ' – Present'",
        f"'Engineer at Globex, ' || {_year(1996, 20)} || '-04 to ' || {_year(1999, 20)} || '/02'",
        f"'Analyst | Initech' || {_LF} || '0' || CAST(1 + c_custkey % 9 AS STRING) || '/' || {_year(2000, 12)} || ' - 12/' || {_year(2001, 12)}",
        f"'Developer, ' || {_year(1944, 90)} || ' – ' || {_year(1946, 95)}",
        "'Consultant · Umbrella'",
        f"'Sept. ' || {_year(2005, 10)} || ' until today -- Team lead'",
        f"'Intern, jan-' || {_year(2010, 6)} || ' thru ' || {_year(2012, 6)} || ' (part time), dec 2030'",
        f"'Head of Data • Hooli ' || {_year(1999, 9)} || ' x ' || {_year(2003, 9)} || ' — ' || {_year(2009, 9)}",
    ),
    _case(4, f"'• Led a team of ' || {_year(2, 17)} || ' and cut costs ' || {_year(1, 60)} || '%'", "'- Responsible for reports to several clients.'", "'1. Manages dashboards for 40+ active users weekly.'", "'Improved throughput 3x without any mark'"),
    _case(5, "'* Built it'", "'• I really improved the checkout flow for our team'", "'(2) Negotiated $' || CAST(1000 + c_custkey AS STRING) || ' k in savings;'", "'wrapped words of an earlier line 5 %'", "'- Maintain 12 responsive marketing sites'"),
    _case(3, f"'Second role, May ' || {_year(1985, 12)} || ', ' || {_year(1990, 12)} || ' - ' || {_year(1992, 12)}", f"'• Bulleted 2001 - 2004 is no header'", f"'Now - 2004 and 3-' || {_year(2000, 9)} || ' to date'"),
    _case(2, "'• Designs models, twice, with 7 people'", "'Supported the team and the THE BOARD OF DIRECTORS AND MANY OTHERS'"),
    _case(4, "'Projects'", "'Volunteering'", "NULL"),
    _case(4, f"'Compiler at Home, 2010 – 2011'", f"'Shelter' || {_LF} || '2013 to 2014'", f"'A line'"),
    _case(2, "'+ Wrote a compiler in 3 weeks for 200 students'", "'Helped with food, 2 days a week'"),
    _case(3, "'Education'", "'Education & Training'", "'Training day'"),
    "'BSc in Maths, ' || " + _year(1980, 30),
    _case(3, "'Skills'", "'Technical Skills: SQL, Python (3), Familiar with Docker'", "'Skills'"),
    "'SQL, Python (3); Familiar with Docker / Spark • ' || c_mktsegment",
    _case(2, "'Skills'", "'Education'"),
)
CV = f"concat_ws({_LF}, {', '.join(_LINES)})"


def cvs(spark, sf_dir):
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", F.expr(CV).alias("cv"))


_SPACES = r"[\s\x{A0}]"
_KINDS = {
    "present": r"(?i)\b(?:present|currently|current|now|today|ongoing|to date|date)\b",
    "month": rf"(?i)\b(?:{'|'.join(sorted((*dates.MONTHS, *dates.SHORT), key=len, reverse=True))})\.?[\s,/-]+\d{{4}}\b",
    "iso": r"\b\d{4}[/-](?:0[1-9]|1[0-2])\b",
    "numeric": r"\b(?:0?[1-9]|1[0-2])[/-]\d{4}\b",
    "year": r"\b(?:19\d\d|20\d\d)\b",
}


def _tokens_sql(lines: str) -> str:
    """CTEs from a table of (c_custkey, line_no, line) to tok: each kind's matches, then those that no earlier kind overlaps."""
    out, held = [], []
    for kind, p in _KINDS.items():
        year = "2026" if kind == "present" else r"CAST(regexp_extract(m, '(?:^|[^0-9])([0-9]{4})(?:$|[^0-9])', 1) AS INTEGER)"
        month = {
            "present": "6",
            "month": "list_position(['" + "','".join(m[:3] for m in dates.MONTHS) + "'], lower(substr(m, 1, 3)))",
            "iso": "CAST(right(m, 2) AS INTEGER)",
            "numeric": r"CAST(regexp_extract(m, '^[0-9]+') AS INTEGER)",
            "year": "CAST(NULL AS INTEGER)",
        }[kind]
        form = {"present": "'present'", "month": "CASE WHEN length(regexp_extract(m, '^[A-Za-z]+')) <= 4 THEN 'Mon YYYY' ELSE 'Month YYYY' END", "iso": "'YYYY-MM'", "numeric": "'MM/YYYY'", "year": "'YYYY'"}[kind]
        out.append(
            f"""{kind}_m AS (SELECT c_custkey, line_no, string_split_regex(line, '{p}') AS gaps, regexp_extract_all(line, '{p}') AS ms FROM {lines}),
{kind}_p AS (SELECT c_custkey, line_no, ms[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS spot
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {kind}_m)),
{kind}_y AS (SELECT c_custkey, line_no, spot, CAST(length(m) AS INTEGER) AS size, {year} AS year, CAST({month} AS INTEGER) AS month, {form} AS format FROM {kind}_p),
{kind}_t AS (SELECT * FROM {kind}_y y WHERE year BETWEEN 1950 AND 2034 {"".join(f" AND NOT EXISTS (SELECT 1 FROM {h}_t h WHERE h.c_custkey = y.c_custkey AND h.line_no = y.line_no AND h.spot < y.spot + y.size AND y.spot < h.spot + h.size)" for h in held)})"""
        )
        held.append(kind)
    return ",\n".join(out) + ",\ntok AS (" + " UNION ALL ".join(f"SELECT * FROM {k}_t" for k in held) + ")"


_SPLIT = f"""cv AS (SELECT c_custkey, {CV} AS cv FROM customer),
raw AS (SELECT c_custkey, unnest(string_split(cv, chr(10))) AS line, unnest(range(0, len(string_split(cv, chr(10))))) AS line_no FROM cv)"""


@query(f"WITH {_SPLIT},\n{_tokens_sql('raw')}\nSELECT c_custkey, CAST(line_no AS INTEGER) AS line_no, spot, size, year, month, format FROM tok")
def date_tokens(spark, sf_dir):
    """Dates in the lines of CVs, with their places."""
    rows = cvs(spark, sf_dir).select("c_custkey", F.posexplode(F.split("cv", "\n")).alias("line_no", "line"))
    rows = rows.select("c_custkey", "line_no", F.explode_outer(dates.date_tokens(F.col("line"), NOW)).alias("t")).where("t is not null")  # outer: computed once, not for a filter as well
    return rows.select("c_custkey", "line_no", F.col("t.at").alias("spot"), "t.size", "t.year", "t.month", "t.format")


def _kind_sql(line: str) -> str:
    bare = f"trim(regexp_replace(regexp_replace(lower({line}), '[^a-z& ]+', ' ', 'g'), ' +', ' ', 'g'))"
    cases = " ".join(f"WHEN regexp_matches({bare}, '^(?:{'|'.join(s)})(?: .{{0,11}})?$') THEN '{k}'" for k, s in resume.HEADINGS.items())
    return f"CASE WHEN length({bare}) NOT BETWEEN 1 AND 45 THEN NULL {cases} END"


_GLYPHS = "[" + ", ".join(f"'{g}'" for g in resume.GLYPHS) + "]"
_IS_BULLET = rf"(list_contains({_GLYPHS}, substr(line, 1, 1)) OR regexp_matches(line, '^\(?\d{{1,2}}[.)]\s+'))"
_STRIPPED = rf"CASE WHEN list_contains({_GLYPHS}, substr(line, 1, 1)) THEN trim(substr(line, 2)) ELSE trim(regexp_replace(line, '^\(?\d{{1,2}}[.)]\s+', '')) END"
#: The windows of sections and roles, in SQL.
_ROLES = rf"""{_SPLIT},
l1 AS (SELECT c_custkey, line_no, trim(line) AS line FROM raw WHERE trim(line) <> ''),
l2 AS (SELECT *, CASE WHEN lead(line_no) OVER (PARTITION BY c_custkey ORDER BY line_no) IS NOT NULL THEN {_kind_sql('line')} END AS kind, {_IS_BULLET} AS bullet FROM l1),
l3 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY c_custkey, kind ORDER BY line_no) = 1 THEN kind END AS heading, bool_or(bullet) OVER (PARTITION BY c_custkey) AS glyphs FROM l2),
l4 AS (SELECT *, last_value(heading IGNORE NULLS) OVER w AS section, count(heading) OVER w AS section_no, count(heading) OVER (PARTITION BY c_custkey) AS n_headings
  FROM l3 WINDOW w AS (PARTITION BY c_custkey ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
own AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, section_no ORDER BY line_no) AS nth FROM l4 WHERE n_headings = 0 OR (section IN ('experience', 'projects', 'volunteer') AND heading IS NULL)),
header AS (SELECT * FROM own WHERE NOT bullet AND length(line) < 120),
{_tokens_sql('header')},
nx AS (SELECT *, lead(spot) OVER w AS spot2, lead(size) OVER w AS size2, lead(year) OVER w AS year2, lead(month) OVER w AS month2, lead(format) OVER w AS format2 FROM tok WINDOW w AS (PARTITION BY c_custkey, line_no ORDER BY spot)),
pair AS (SELECT nx.*, row_number() OVER (PARTITION BY c_custkey, line_no ORDER BY spot) AS k, substr(line, spot + 1, spot2 + size2 - spot) AS raw
  FROM nx JOIN header USING (c_custkey, line_no) WHERE spot2 IS NOT NULL AND format <> 'present' AND spot2 - spot - size <= 12
  AND regexp_matches(substr(line, spot + size + 1, spot2 - spot - size), '(?i)^\s*(?:[–—‒−-]{{1,2}}|to|until|through|thru|till)\s*$')),
rng AS (SELECT *, greatest(0, (year2 - year) * 12 + coalesce(month2, 12) - coalesce(month, 1) + 1) AS months FROM pair WHERE k = 1),
d AS (SELECT own.*, raw, year, month, year2, month2, format2 = 'present' AS current, months, months IS NOT NULL AS dated FROM own LEFT JOIN rng USING (c_custkey, line_no)),
e AS (SELECT *, nth = 2 AND dated AND NOT first_value(dated) OVER (PARTITION BY c_custkey, section_no ORDER BY line_no) AS joins FROM d),
r AS (SELECT *, sum(CASE WHEN nth = 1 OR (dated AND NOT joins) THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey ORDER BY line_no) - 1 AS role_no, nth = 1 OR dated AS is_head,
  CASE WHEN bullet THEN {_STRIPPED} ELSE line END AS said FROM e),
b AS (SELECT *, len(string_split_regex(said, '\s+')) AS n_words, NOT is_head AND len(string_split_regex(said, '\s+')) >= 3 AS counts, bullet OR NOT glyphs AS marked FROM r)"""


@query(
    rf"""WITH {_ROLES},
g AS (SELECT c_custkey, role_no, CASE WHEN max(n_headings) = 0 THEN 'experience' ELSE min(section) END AS source, string_agg(line, ' ' ORDER BY line_no) FILTER (is_head) AS header,
  max(raw) AS raw, max(year) AS start_year, max(month) AS start_month, max(year2) AS end_year, max(month2) AS end_month, bool_or(current) AS current, max(months) AS months,
  coalesce(string_agg(said, chr(10) ORDER BY line_no) FILTER (counts AND marked), '') AS bullets, coalesce(sum(n_words) FILTER (counts AND NOT marked), 0) AS prose_words FROM b GROUP BY ALL),
h AS (SELECT *, CASE WHEN instr(header, raw) > 0 THEN substr(header, 1, instr(header, raw) - 1) || ' ' || substr(header, instr(header, raw) + length(raw)) ELSE header END AS bare FROM g),
p AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(trim(regexp_replace(regexp_replace(bare, '[|·•]', ' | ', 'g'), '\s{{2,}}', ' ', 'g')), '[,|–—-]\s*$', ''), '{resume.ORG_SEPARATOR}'), lambda x: trim(x)), lambda x: length(x) > 1) AS parts FROM h)
SELECT c_custkey, CAST(role_no AS BIGINT) AS role_no, source, header, parts[1] AS title, CASE WHEN len(parts) > 1 THEN array_to_string(parts[2:], ', ') END AS organisation, raw, start_year, start_month, end_year, end_month, current,
  CAST(months AS INTEGER) AS months, bullets, CAST(prose_words AS INTEGER) AS prose_words FROM p"""
)
def cv_roles(spark, sf_dir):
    """Roles of CVs: source, header, title, organisation, dates, bullets."""
    rows = resume.lines(cvs(spark, sf_dir), "c_custkey", "cv")
    out = resume.roles(resume.marked_lines(resume.role_lines(rows, "c_custkey", NOW), "c_custkey"), "c_custkey")
    d = ("raw", "start_year", "start_month", "end_year", "end_month", "current", "months")
    return out.select("c_custkey", "role_no", "source", "header", "title", "organisation", *(f"dates.{c}" for c in d), F.array_join("bullets", "\n").alias("bullets"), "prose_words")


def _metric_sql(p: str) -> str:
    return f"regexp_extract_all(said, '{p}')"


@query(
    rf"""WITH {_ROLES},
m AS (SELECT c_custkey, role_no, line_no, said, ' ' || lower(said) || ' ' AS low, (list_transform({' || '.join(_metric_sql(p) for p in resume.METRICS.values())}, lambda x: trim(x)))[1:8] AS metrics FROM b WHERE counts AND marked)
SELECT c_custkey, CAST(role_no AS BIGINT) AS role_no, CAST(line_no AS INTEGER) AS line_no, said AS bullet, array_to_string(metrics, '|') AS metrics,
  list_filter([{', '.join(repr(w) for w in sorted(resume.WEAK, key=len, reverse=True))}], lambda w: contains(low, ' ' || w))[1] AS weak_opener,
  array_to_string(list_filter([{', '.join(repr(w) for w in resume.CLICHES)}], lambda w: contains(low, w)), '|') AS cliches, array_to_string(list_filter([{', '.join(repr(w) for w in resume.HEDGES)}], lambda w: contains(low, ' ' || w || ' ')), '|') AS hedges,
  regexp_matches(low, ' (?:i |i,|i''|my |me |mine |myself|we |our |us )') OR regexp_matches(said, '(?i)^i\b') AS first_person, regexp_matches(said, '[.;]$') AS stopped FROM m"""
)
def cv_bullets(spark, sf_dir):
    """Bullets of roles with their metrics and the phrases that cost points."""
    rows = resume.lines(cvs(spark, sf_dir), "c_custkey", "cv")
    b = resume.marked_lines(resume.role_lines(rows, "c_custkey", NOW), "c_custkey").where("is_bullet")
    return b.select("c_custkey", "role_no", "line_no", "bullet", *(F.array_join(c, "|").alias(c) for c in ("metrics", "cliches", "hedges")), "weak_opener", "first_person", "stopped")


#: Ratios of checks as rows, for the roll-up alone: of each order, some checks don't apply.
_CHECK_ROWS = ", ".join(f"('{k}', '{c}', {w}, '{s}', '{scope or checks.CATEGORIES[c][1]}', {checks.CATEGORIES[c][0]}.0::DOUBLE, {i})" for i, (k, (c, w, s, scope)) in enumerate(checks.CHECKS.items()))
_RATIO = "((o_orderkey * 7 + i * 13) % 11) / 10.0"
_BASE = f"""WITH c(chk, category, weight, severity, scope, cw, i) AS (VALUES {_CHECK_ROWS}),
s AS (SELECT *, weight * cw / sum(weight) OVER (PARTITION BY category) AS share FROM c),
r AS (SELECT o_orderkey, s.*, CAST(((o_orderkey * 7 + i * 13) % 11) AS DOUBLE) / 10 AS ratio FROM orders, s WHERE (o_orderkey + i) % 5 <> 0 AND NOT (o_orderkey % 3 = 0 AND scope = 'relevance'))"""


def _ratios(spark, sf_dir):
    c = spark.createDataFrame(list(enumerate(checks.CHECKS)), "i int, check string")
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").crossJoin(F.broadcast(c))  # 43 rows
    said = (F.col("o_orderkey") * 7 + F.col("i") * 13) % 11
    fit = rows.withColumn("scope", F.when(F.col("check").isin(*(k for k, (cat, _, _, scope) in checks.CHECKS.items() if (scope or checks.CATEGORIES[cat][1]) == "relevance")), "relevance"))
    fit = fit.where(((F.col("o_orderkey") + F.col("i")) % 5 != 0) & ~((F.col("o_orderkey") % 3 == 0) & (F.coalesce("scope", F.lit("")) == "relevance")))
    return fit.select("o_orderkey", "check", (said.cast("double") / 10).alias("ratio"))


_GRADE = "CASE " + " ".join(f"WHEN {{0}} >= {n} THEN '{g}'" for n, g in checks.GRADES) + " WHEN {0} IS NOT NULL THEN 'F' END"
_HALF = "CAST(floor(round({0}, 9) + 0.5) AS INTEGER)"
_CATS = ", ".join(f"coalesce({_HALF.format(f'100 * sum(ratio * weight) FILTER (category = {c!r}) / sum(weight) FILTER (category = {c!r})')}, 100) AS {c}" for c in checks.CATEGORIES)


@query(
    f"""{_BASE},
t AS (SELECT o_orderkey, {_CATS}, 100 * sum(ratio * share) FILTER (scope = 'quality') / sum(share) FILTER (scope = 'quality') AS q, 100 * sum(ratio * share) FILTER (scope = 'relevance') / sum(share) FILTER (scope = 'relevance') AS f FROM r GROUP BY o_orderkey),
u AS (SELECT *, {_HALF.format("least(q, CASE WHEN parse < 25 THEN 28 WHEN parse < 50 THEN 48 WHEN parse < 70 THEN 68 ELSE 100 END)")} AS score, {_HALF.format("f")} AS relevance FROM t)
SELECT o_orderkey, score, {_GRADE.format("score")} AS grade, relevance, {_GRADE.format("relevance")} AS relevance_grade, {", ".join(checks.CATEGORIES)} FROM u"""
)
def check_scores(spark, sf_dir):
    """The roll-up of ratios that follow from the orders' keys: two scopes, fixed shares, caps."""
    return checks.roll_up(_ratios(spark, sf_dir), "o_orderkey")


@query(
    f"""{_BASE},
f AS (SELECT *, floor(round((1 - ratio) * share * 10, 9) + 0.5) / 10 AS lost FROM r WHERE ratio < 0.999)
SELECT o_orderkey, string_agg(printf('- **%s** %s (%s): -%.1f', severity, chk, category, lost), chr(10) ORDER BY list_position(['critical', 'important', 'polish'], severity), lost DESC, chk) AS found FROM f GROUP BY o_orderkey"""
)
def check_findings(spark, sf_dir):
    """Findings as lines of Markdown, the severest and costliest first, within the whole report."""
    long = _ratios(spark, sf_dir)
    out = checks.report(checks.roll_up(long, "o_orderkey"), checks.findings(long, "o_orderkey"), "o_orderkey")
    found = F.regexp_replace(F.substring_index("markdown", "## Findings\n\n", -1), "\n$", "")
    return out.select("o_orderkey", found.alias("found")).where("found <> '- nothing'")


@query()
def resume_scores(spark, sf_dir):
    """All 43 checks on the customers' CVs, rolled up; each is aimed at a department and an advert."""
    own = cvs(spark, sf_dir)
    fields = spark.createDataFrame([("machinery", "repository", "projects", ["sql", "python", "docker", "spark", "go"], ["cost", "throughput"]), ("building", "none", "certifications", ["sql", "safety"], ["site"]), ("household", "portfolio", None, ["design"], [])], "department string, link string, section string, core_skills array<string>, outcome_words array<string>")
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    targets = customers.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "Senior Analyst").alias("target_role"), F.lower("c_mktsegment").alias("department"))
    adverts = customers.where("c_custkey % 3 <> 0").select("c_custkey", F.concat(F.lit("We need an analyst who knows sql and python, sql above all, and python models for a team of analysts. "), F.repeat(F.concat(F.lower("c_mktsegment"), F.lit(" ")), F.lit(2))).alias("advert"))
    f = checks.facts(own, "c_custkey", "cv", NOW, targets=targets, departments=fields, adverts=adverts)
    return checks.roll_up(checks.ratios(f, "c_custkey"), "c_custkey")


@query()
def resume_coaching(spark, sf_dir):
    return resume.coaching(resume.lines(cvs(spark, sf_dir), "c_custkey", "cv"), "c_custkey")


@query()
def cv_contacts(spark, sf_dir):
    out = resume.contact(resume.lines(cvs(spark, sf_dir), "c_custkey", "cv"), "c_custkey")
    return out.withColumns({c: F.array_join(c, "|") for c in ("sensitive", "degrees")})


#: What a customer's CV is held against.
ADVERT = "'We need an analyst who knows sql and python: sql above all, python models and reports for a team of analysts, reports on ' || lower(c_mktsegment) || ', ' || lower(c_mktsegment) || ' and c++ or c++ ; lyon lyon'"


@query(
    rf"""WITH a AS (SELECT c_custkey, {CV} AS cv, regexp_extract_all(lower({ADVERT}), '[a-z][a-z0-9+#.]{{1,24}}') AS x FROM customer),
e AS (SELECT c_custkey, cv, unnest(x) AS term, unnest(range(len(x))) AS spot FROM a),
t AS (SELECT c_custkey, cv, term, count(*) AS n, min(spot) AS spot FROM e WHERE term NOT IN ({", ".join(repr(w) for w in STOP_WORDS)}) AND length(term) >= 3 GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, spot) AS place, ' ' || regexp_replace(regexp_replace(lower(cv), '[^a-z0-9+#./ -]', ' ', 'g'), '\s+', ' ', 'g') || ' ' AS h FROM t)
SELECT c_custkey, term, n, CAST(place AS INTEGER) AS place, contains(h, ' ' || term || ' ') OR contains(h, ' ' || term || 's ') OR (suffix(term, 's') AND contains(h, ' ' || left(term, -1) || ' ')) OR regexp_matches(h, '' || regexp_escape(term) || '') AS present FROM r WHERE place <= 28"""
)
def advert_terms(spark, sf_dir):
    """The terms of each customer's advert, and whether the CV has them."""
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", F.expr(ADVERT).alias("advert"))
    return checks.advert_coverage(cvs(spark, sf_dir), "c_custkey", "cv", customers)


@query(
    rf"""WITH {_ROLES},
w AS (SELECT c_custkey, line_no, said, ' ' || lower(said) || ' ' AS low FROM b WHERE counts AND marked AND len({" || ".join(_metric_sql(p) for p in resume.METRICS.values())}) = 0),
k AS (SELECT c_custkey, string_agg(said, chr(10) ORDER BY line_no) AS unmeasured FROM w GROUP BY c_custkey)
SELECT c_custkey, regexp_replace(regexp_replace(cv, '{resume.EMAIL}', '[email removed]', 'g'), '\+\d[\d\s().-]{{8,16}}\d', '[phone removed]', 'g') AS cv, coalesce(unmeasured, '') AS unmeasured FROM cv LEFT JOIN k USING (c_custkey)"""
)
def cv_reviews(spark, sf_dir):
    """What a review is given of each CV: its text without addresses and numbers, and the bullets that say no number."""
    own = cvs(spark, sf_dir)
    f = checks.findings(checks.ratios(checks.facts(own, "c_custkey", "cv", NOW), "c_custkey"), "c_custkey")
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", F.expr(ADVERT).alias("advert"))
    out = checks.review_payload(own, "c_custkey", "cv", NOW, f, checks.advert_coverage(own, "c_custkey", "cv", customers))
    measured = lambda b: F.size(resume.metrics(b)) > 0
    return out.select("c_custkey", "cv", F.array_join(F.filter("weak_bullets", lambda b: ~measured(b)), "\n").alias("unmeasured"))
