"""Queries over matches, rules, items and nested JSON, on data made from the tables so that every case occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoding, numeric
from ..functions import text as T
from ..operators import delimited, items, jsons, matches, resume, skills
from .registry import query, spread, table

# ---- matches and rules

NAMES = r"([A-Z])([a-z]{7,})"


@query(rf"""WITH m AS (SELECT doc_id, text, string_split_regex(text, '{NAMES}') AS gaps, regexp_extract_all(text, '{NAMES}') AS m, regexp_extract_all(text, '{NAMES}', 1) AS g, regexp_extract_all(text, '{NAMES}', 2) AS h FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM m),
i AS (SELECT *, CAST(list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS i FROM e),
p AS (SELECT *, substr(text, 1, i) AS before FROM i)
SELECT doc_id, CAST(n AS INTEGER) AS n, i AS "index", 1 + length(before) - length(replace(before, chr(10), '')) AS line, length(regexp_extract(before, '[^\n]*$')) + 1 AS "column", m[n] AS "match", g[n] || '|' || h[n] AS captures FROM p""")
def regex_places(spark, sf_dir):
    found = matches.find_all(table(spark, sf_dir, "documents"), "doc_id", "text", NAMES, 2)
    return found.withColumn("captures", F.array_join("captures", "|"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(coalesce(list_sum(list_transform(l[1:n - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS "index", CAST(n AS INTEGER) AS line, 1 AS "column", '' AS "match" FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM l)""")
def line_starts(spark, sf_dir):
    """Matches of nothing: the places where lines begin."""
    return matches.find_all(table(spark, sf_dir, "documents"), "doc_id", "text", "^", flags="gm").drop("captures")


PATTERNS = ("(a+)+", "(a*)*$", "(a|b)*c+", "(a|b)*", "a.*.*.*b", "x.+.+.+y", "(?:ab){2}", "[a-z]+", "(a+){2,}", "")


@query(f"""WITH p AS (SELECT o_orderkey, ([{", ".join(f"'{p}'" for p in PATTERNS)}])[1 + o_orderkey % {len(PATTERNS)}] AS p FROM orders)
SELECT o_orderkey, p AS pattern, CASE WHEN p IN ('(a+)+', '(a*)*$', '(a+){{2,}}') THEN 'a quantifier applied to a group that already repeats — for example (a+)+' WHEN p = '(a|b)*c+' OR p = '(a|b)*' THEN 'an alternation inside a repeated group, which can backtrack exponentially'
  WHEN p IN ('a.*.*.*b', 'x.+.+.+y') THEN 'several unbounded wildcards in sequence' END AS risk FROM p""")
def pattern_risks(spark, sf_dir):
    p = F.element_at(F.array(*map(F.lit, PATTERNS)), (F.col("o_orderkey") % len(PATTERNS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("pattern")).withColumn("risk", matches.pattern_risk(F.col("pattern")))


RULES = """
# a comment
the => THE
license
. => <$&>
"""


@query("""WITH a AS (SELECT doc_id, text, regexp_replace(text, 'the', 'THE', 'g') AS one, len(regexp_extract_all(text, 'the')) AS n1 FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, replace(one, 'license', '') AS two, len(regexp_extract_all(one, 'license')) AS n2 FROM a), c AS (SELECT *, replace(two, '.', '<.>') AS three, len(regexp_extract_all(two, '\\.')) AS n3 FROM b),
l AS (SELECT *, string_split(text, chr(10)) AS x, string_split(three, chr(10)) AS y FROM c)
SELECT doc_id, three AS output, n1 || ',' || n2 || ',' || n3 AS "matches", array_to_string(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS DISTINCT FROM y[i])[1:20], ',') AS changed FROM l""")
def rule_outcomes(spark, sf_dir):
    done = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", matches.apply_rules(F.col("text"), matches.parse_rules(RULES)).alias("r"))
    changed = matches.changed_lines(F.col("text"), F.col("r.output"))
    return done.select("doc_id", "r.output", F.array_join(F.col("r.matches").cast("array<string>"), ",").alias("matches"), F.array_join(changed.cast("array<string>"), ",").alias("changed"))


@query(r"""WITH t AS (SELECT conv_id, turn, text, regexp_replace(lower(text), '\s+', ' ', 'g') AS hay FROM conversations WHERE text IS NOT NULL AND length(text) > 60),
r AS (SELECT conv_id * 1000 + turn AS k, hay, CASE WHEN turn % 4 = 0 THEN substr(text, 3, 30) WHEN turn % 4 = 1 THEN substr(text, 1, 45) || ' and a tail' WHEN turn % 4 = 2 THEN 'a paraphrase of ' || substr(text, 1, 20) ELSE '- ' || replace(upper(substr(text, 1, 25)), 'ẞ', 'SS') END AS b FROM t),
s AS (SELECT k, hay, regexp_replace(trim(b), '^[-•·*\s]+', '') AS b FROM r WHERE length(trim(b)) > 8), n AS (SELECT *, regexp_replace(lower(b), '\s+', ' ', 'g') AS needle FROM s)
SELECT k, b AS "before" FROM n WHERE contains(hay, needle) OR (length(needle) > 40 AND contains(hay, substr(needle, 1, 40)))""")
def verified_rewrites(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("text is not null and length(text) > 60").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "turn", "text")
    kind = F.col("turn") % 4
    before = F.when(kind == 0, F.substring("text", 3, 30)).when(kind == 1, F.concat(F.substring("text", 1, 45), F.lit(" and a tail"))).when(kind == 2, F.concat(F.lit("a paraphrase of "), F.substring("text", 1, 20))).otherwise(F.concat(F.lit("- "), F.upper(F.substring("text", 1, 25))))
    rewrites = t.select("k", F.lit(0).alias("at"), before.alias("before"), F.lit("a new sentence").alias("after"))
    return matches.verified_rewrites(rewrites, t, "k", "text", "at").select("k", "before")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority END AS verdict FROM orders""")
def structured_replies(spark, sf_dir):
    body = lambda c: F.concat(F.lit('{"verdict": "'), F.col(c), F.lit('", "gaps": ["x"]}'))
    kind = F.col("o_orderkey") % 4
    reply = F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), body("o_orderstatus"), F.lit("\n```\nDone."))).when(kind == 1, body("o_orderpriority")).when(kind == 2, F.lit("Sorry, I can't.")).otherwise(F.lit('{"gaps": []}'))
    value = matches.structured(reply, "verdict string, gaps array<string>", ["verdict", "gaps"])
    return table(spark, sf_dir, "orders").select("o_orderkey", value["verdict"].alias("verdict"))


# ---- numbers, encodings and names


@query("SELECT o_orderkey, floor((20000.0 - a) * 100.0 + 0.5) / 100.0 AS points, CASE WHEN a = 0 THEN 'NaN' ELSE CAST(floor((20000.0 - a) / abs(a) * 100 * 100.0 + 0.5) / 100.0 AS VARCHAR) END AS relative FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS a FROM orders)")
def point_changes(spark, sf_dir):
    a = F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice"))
    found = numeric.percentage_points(a, F.lit(20000.0))
    shown = F.when(F.isnan(found["relative"]), "NaN").otherwise(T.half_up(found["relative"], 2).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.half_up(found["points"], 2).alias("points"), shown.alias("relative"))


@query("""WITH b AS (SELECT p_partkey, p_partkey % 120 AS bits FROM part), s AS (SELECT *, pow(2.0, bits - 1) / 1e12 AS s FROM b),
v AS (SELECT *, CASE WHEN s < 60 THEN s WHEN s < 3600 THEN s / 60 WHEN s < 86400 THEN s / 3600 WHEN s < 31536000 THEN s / 86400 WHEN s < 31536000000 THEN s / 31536000 WHEN s < 31536000000000 THEN s / 31536000000 ELSE s / 31536000000000 END AS v,
  CASE WHEN s < 60 THEN 'seconds' WHEN s < 3600 THEN 'minutes' WHEN s < 86400 THEN 'hours' WHEN s < 31536000 THEN 'days' WHEN s < 31536000000 THEN 'years' WHEN s < 31536000000000 THEN 'thousand years' ELSE 'million years' END AS u FROM s)
SELECT p_partkey, CASE WHEN s < 1 THEN 'instantly' WHEN v > 1000 THEN 'longer than the age of the universe' WHEN v < 10 THEN printf('%.1f', floor(v * 10.0 + 0.5) / 10.0) || ' ' || u ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) || ' ' || u END AS label FROM v""")
def crack_times(spark, sf_dir):
    label = F.replace(numeric.crack_time((F.col("p_partkey") % 120).cast("double")), F.lit(","), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN c_name || ' naïve' WHEN 2 THEN to_base64(encode(rtrim(to_base64(encode(c_name || '~')), '='))) WHEN 3 THEN to_base64(encode('é' || c_name)) ELSE to_base64(encode(c_name || ',')) END AS output FROM customer""")
def base64_auto(spark, sf_dir):
    c, b = F.col("c_name"), encoding.base64
    kind = F.col("c_custkey") % 4
    # a text in Base64, an unpadded one of a length that can't be whole, a plain text with an accent, and a plain one
    given = F.when(kind == 1, b(F.concat(c, F.lit(" naïve")))).when(kind == 2, F.rtrim(b(F.concat(c, F.lit("~"))), F.lit("="))).when(kind == 3, F.concat(F.lit("é"), c)).otherwise(F.concat(c, F.lit(",")))
    return table(spark, sf_dir, "customer").select("c_custkey", encoding.base64_auto(given).alias("output"))


@query(r"""WITH n AS (SELECT p_partkey, p_name || ([' boxes', ' entries', ' status', ' class-lists', '9 gears', ' x']) [1 + p_partkey % 6] AS s FROM part),
t AS (SELECT p_partkey, s, CASE WHEN regexp_matches(s, '(?i)ies$') AND length(s) > 4 THEN substr(s, 1, length(s) - 3) || 'y' WHEN regexp_matches(s, '(?i)(s|x|z|ch|sh)es$') THEN substr(s, 1, length(s) - 2) WHEN regexp_matches(s, '(?i)[^su]s$') THEN substr(s, 1, length(s) - 1) ELSE s END AS one FROM n)
SELECT p_partkey, one AS singular, array_to_string(list_transform(list_filter(string_split_regex(one, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') AS type_name FROM t""")
def type_names(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, (" boxes", " entries", " status", " class-lists", "9 gears", " x"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    one = T.singular(F.concat("p_name", ends))
    return table(spark, sf_dir, "part").select("p_partkey", one.alias("singular"), T.type_name(one).alias("type_name"))


def _targets() -> str:
    from .registry import ORACLE_SQL

    each = ", ".join(f"('{k}', {v})" for k, v in T.TARGETS.items())
    return f"SELECT doc_id, target, ease >= least_ease AS passes FROM ({ORACLE_SQL['readability']}), (VALUES {each}) t(target, least_ease)"


@query(_targets())
def readability_targets(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.readability_counts(F.col("text")).alias("counts"))
    scored = counted.select("doc_id", T.readability(F.col("counts"))["ease"].alias("ease"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("target"), F.lit(v).alias("least")) for k, v in T.TARGETS.items())))
    return scored.select("doc_id", "ease", each.alias("t")).select("doc_id", "t.target", (F.col("ease") >= F.col("t.least")).alias("passes"))


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS secret, CASE WHEN p_partkey % 4 = 0 THEN 'data:image/png;base64,AAA=' END AS picture FROM part""")
def guarded_options(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.element_at(F.array(*map(F.lit, ("password", "api_key", "my.Secret", "salt"))), (k % 4 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, ("passenger", "compass", "length", "tokens"))), (k % 4 + 1).cast("int")))
    photo = F.element_at(F.array(*map(F.lit, ("data:image/png;base64,AAA=", "data:image/svg+xml;base64,AAA=", "https://x/y.png", "data:image/png;base64,A<A"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", items.is_secret(name).alias("secret"), items.safe_picture(photo).alias("picture"))


# ---- delimited cells with quotes, delimiters and line ends

CELLS = """s_suppkey || '' AS a, s_name || CASE s_suppkey % 4 WHEN 0 THEN ', "' || s_suppkey || '"' WHEN 1 THEN '; x' WHEN 2 THEN chr(10) || 'two' ELSE '' END AS b, CASE WHEN s_suppkey % 3 = 0 THEN '=1+1' ELSE '' END AS c"""
QUOTED = lambda d: "CASE WHEN contains({0}, '" + d + """') OR regexp_matches({0}, '["\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


def _cells(spark, sf_dir):
    k = F.col("s_suppkey")
    more = F.when(k % 4 == 0, F.concat(F.lit(', "'), k, F.lit('"'))).when(k % 4 == 1, F.lit("; x")).when(k % 4 == 2, F.lit("\ntwo")).otherwise(F.lit(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", k.cast("string").alias("a"), F.concat("s_name", more).alias("b"), F.when(k % 3 == 0, "=1+1").otherwise("").alias("c"))


def _csv(d: str, guard: bool) -> str:
    cell = "CASE WHEN regexp_matches({0}, '^[=+@\\t\\r-]') THEN '''' || {0} ELSE {0} END" if guard else "{0}"
    return f" || '{d}' || ".join(QUOTED(d).format(f"({cell.format(c)})") for c in "abc")


@query(f"""WITH c AS (SELECT s_suppkey, {CELLS} FROM supplier) SELECT s_suppkey, {_csv(",", False)} AS csv, {_csv(";", True)} AS semicolons, a || '|' || b || '|' || c AS back FROM c""")
def quoted_rows(spark, sf_dir):
    cells = [F.col(c) for c in "abc"]
    csv = delimited.csv_row(cells)
    return _cells(spark, sf_dir).select("s_suppkey", csv.alias("csv"), delimited.csv_row(cells, guard=True, delimiter=";").alias("semicolons"), F.array_join(delimited.parse_line(csv), "|").alias("back"))


@query(f"""WITH c AS (SELECT s_suppkey, {CELLS} FROM supplier)
SELECT s_suppkey, '  {{' || chr(10) || '    "a": ' || to_json(a) || ',' || chr(10) || '    "b": ' || to_json(b) || chr(10) || '  }}' AS object, '  [' || chr(10) || '    ' || to_json(a) || ',' || chr(10) || '    ' || to_json(b) || chr(10) || '  ]' AS list FROM c""")
def json_rows(spark, sf_dir):
    cells = [F.col("a"), F.col("b")]
    return _cells(spark, sf_dir).select("s_suppkey", delimited.json_row(["a", "b"], cells).alias("object"), delimited.json_array_row(cells).alias("list"))


@query(f"""WITH c AS (SELECT s_suppkey, {CELLS} FROM supplier) SELECT s_suppkey, CAST(row_number AS INTEGER) AS row_no, list AS cells FROM (
  SELECT s_suppkey, 0 AS row_number, a || '|' || b || '|' || c AS list FROM c UNION ALL SELECT s_suppkey, 1, 'x|' || b FROM c)""")
def quoted_parse(spark, sf_dir):
    cells = [F.col(c) for c in "abc"]
    text = F.concat(delimited.csv_row(cells), F.lit("\r\n"), delimited.csv_row([F.lit("x"), F.col("b")]), F.lit("\n"))
    return delimited.parse(_cells(spark, sf_dir).withColumn("t", text), "s_suppkey", "t").select("s_suppkey", "row_no", F.array_join("cells", "|").alias("cells"))


# ---- nested JSON

NESTED = """'{"b": [' || o_custkey || ', {"z": ' || o_orderkey || '}, "' || o_orderstatus || '"], "a b": {"y": null, "x": "' || o_orderpriority || '"}' || CASE WHEN o_orderkey % 3 = 0 THEN ', "e": {}' ELSE '' END || '}'"""


def _nested(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", F.expr(NESTED).alias("doc"))


def _orders(spark, sf_dir):
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


@query("""SELECT o_orderkey, '{"a b":{"x":"' || o_orderpriority || '","y":null},"b":[' || array_to_string(list_sort([CAST(o_custkey AS VARCHAR), '{"z":' || o_orderkey || '}', '"' || o_orderstatus || '"']), ',') || ']' || CASE WHEN o_orderkey % 3 = 0 THEN ',"e":{}' ELSE '' END || '}' AS canonical FROM orders""")
def canonical_json(spark, sf_dir):
    return jsons.canonical(_nested(spark, sf_dir), "o_orderkey", "doc", sort_arrays=True)


def _sides(spark, sf_dir):
    """A document and one that differs: a list's number is a text, a status changes, a key goes and another comes."""
    both = _orders(spark, sf_dir).withColumn("doc", F.expr(NESTED))
    right = F.expr("""replace(replace(replace(doc, '"y": null, ', '"w": true, '), '"' || o_orderstatus || '"]', '"' || lower(o_orderstatus) || '"]'), '[' || o_custkey || ',', '["' || o_custkey || '",')""")
    return both.select("o_orderkey", "doc"), both.select("o_orderkey", right.alias("doc"))


@query("""SELECT o_orderkey, line FROM (
  SELECT o_orderkey, '! $.b[0]: ' || o_custkey || ' (number) → ' || o_custkey || ' (string)' AS line FROM orders UNION ALL SELECT o_orderkey, '~ $.b[2]: ' || o_orderstatus || ' → ' || lower(o_orderstatus) FROM orders
  UNION ALL SELECT o_orderkey, '− $["a b"].y: null' FROM orders UNION ALL SELECT o_orderkey, '+ $["a b"].w: true' FROM orders)""")
def json_change_lines(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    changes = jsons.diff(left, right, "o_orderkey", "doc", types=True)
    line = jsons.change_line(F.col("kind"), F.col("path"), jsons.clip(F.col("left")), jsons.clip(F.col("right")), F.col("left_type"), F.col("right_type"))
    return changes.select("o_orderkey", line.alias("line"))


@query("SELECT o_orderkey, 1 AS added, 1 AS removed, 1 AS changed, 1 AS type_changed, 2 AS unchanged, false AS identical FROM orders")
def json_diff_stats(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return jsons.diff_counts(left, right, "o_orderkey", "doc")


# ---- items: parts as a list of things to rank, with a status of their own

ITEMS = """SELECT p_partkey AS id, p_name AS name, p_brand AS category, p_type AS cluster, CASE WHEN p_partkey % 7 = 0 THEN 'draft' WHEN p_partkey % 11 = 0 THEN 'deprecated' ELSE 'live' END AS status, p_size AS score, p_partkey * 37 % 1000 AS updated FROM part"""


def _items(spark, sf_dir):
    k = F.col("p_partkey")
    status = F.when(k % 7 == 0, "draft").when(k % 11 == 0, "deprecated").otherwise("live")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_type").alias("cluster"), status.alias("status"), F.col("p_size").alias("score"), (k * 37 % 1000).alias("updated"))


@query(f"SELECT id, score, CASE WHEN score >= 40 THEN 'build-now' WHEN score >= 30 THEN 'backlog' WHEN score >= 20 THEN 'cluster-only' ELSE 'skip' END AS verdict FROM ({ITEMS}) WHERE status <> 'deprecated'")
def item_verdicts(spark, sf_dir):
    return items.visible(_items(spark, sf_dir)).select("id", "score", items.score_verdict(F.col("score")).alias("verdict"))


@query(f"SELECT category, id, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, name, id) AS INTEGER) AS place FROM ({ITEMS}) WHERE status = 'live' QUALIFY place <= 8")
def top_by_category(spark, sf_dir):
    ranked = items.live(_items(spark, sf_dir)).withColumn("order", F.struct("name", "id"))
    return items.top_in_group(ranked, "category", "score", "order", 8).select("category", "id", "place")


@query(f"SELECT name, cluster, count(*) AS n FROM ({ITEMS}) GROUP BY ALL HAVING count(*) > 1")
def repeated_names(spark, sf_dir):
    return items.repeated(_items(spark, sf_dir), "name", "cluster")


@query(f"SELECT category, false AS overall, count(*) AS n, max(updated) AS newest FROM ({ITEMS}) WHERE status = 'live' GROUP BY category UNION ALL SELECT NULL, true, count(*), max(updated) FROM ({ITEMS}) WHERE status = 'live'")
def category_counts(spark, sf_dir):
    return items.group_counts(items.live(_items(spark, sf_dir)), "category", "updated")


@query(f"SELECT count(*) AS items, count(*) FILTER (status = 'live') AS live, count(DISTINCT category) FILTER (status = 'live') AS groups FROM ({ITEMS})")
def item_health(spark, sf_dir):
    return items.health(_items(spark, sf_dir), "category")


@query(f"""WITH i AS (SELECT id, list_filter([CASE WHEN score < 30 AND status = 'live' THEN 'score ' || score || '/50' END, CASE WHEN length(name) < 10 THEN 'a name of ' || length(name) || ' characters' END, CASE WHEN updated < 100 THEN 'stale' END], lambda x: x IS NOT NULL) AS issues FROM ({ITEMS}))
SELECT id, array_to_string(issues, '; ') AS issues FROM i WHERE len(issues) > 0""")
def thin_items(spark, sf_dir):
    score, name = F.col("score"), F.length("name")
    rules = [((score < 30) & (F.col("status") == "live"), F.format_string("score %d/50", score)), (name < 10, F.format_string("a name of %d characters", name)), (F.col("updated") < 100, F.lit("stale"))]
    return items.thin(_items(spark, sf_dir), "id", rules).withColumn("issues", F.array_join("issues", "; "))


@query(f"""WITH i AS (SELECT * FROM ({ITEMS}) WHERE status = 'live'), x AS (SELECT a.id, b.id AS other, 1 AS kind, 0 AS r FROM i a JOIN i b ON b.id = a.id + 1 WHERE a.id % 2 = 0),
f AS (SELECT a.id, b.id AS other, 2 AS kind, row_number() OVER (PARTITION BY a.id ORDER BY b.score DESC, b.id) AS r FROM i a JOIN i b ON a.cluster = b.cluster AND a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.id = a.id AND x.other = b.id))
SELECT id, other, CAST(row_number() OVER (PARTITION BY id ORDER BY kind, r) AS INTEGER) AS place FROM (SELECT * FROM x UNION ALL SELECT * FROM f) QUALIFY place <= 3""")
def next_steps(spark, sf_dir):
    live = items.live(_items(spark, sf_dir))
    explicit = live.where("id % 2 = 0").select("id", (F.col("id") + 1).alias("other"), F.lit(0).alias("at"))
    return items.next_steps(live, explicit, "id", "cluster", "score")


@query(f"""SELECT name, category, score, coalesce(sold, 0) AS sold, id FROM ({ITEMS}) LEFT JOIN (SELECT l_partkey AS id, count(*) AS sold FROM lineitem GROUP BY 1) USING (id) WHERE status = 'live'""")
def item_export(spark, sf_dir):
    """The live items with what another table says of them; a writer orders them by score."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("sold"))
    return items.live(_items(spark, sf_dir)).join(sold, "id", "left").select("name", "category", "score", F.coalesce("sold", F.lit(0)).alias("sold"), "id").orderBy(F.desc("score"), "id")


@query("SELECT DISTINCT c_custkey, p AS priority FROM customer, (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = p)")
def missing_priorities(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"))
    five = F.broadcast(orders.select("priority").distinct())  # there are five
    wanted = table(spark, sf_dir, "customer").select("c_custkey").distinct().crossJoin(five)
    return items.missing(wanted, orders.distinct(), "c_custkey", "priority")


@query("""SELECT p_partkey, 3 - len(g) AS done, 3 AS total, array_to_string(g, ',') AS missing FROM (SELECT p_partkey, list_filter([CASE WHEN p_size <= 10 THEN 'size' END, CASE WHEN p_retailprice <= 950 THEN 'price' END, CASE WHEN NOT contains(p_name, 'bolt') THEN 'bolt' END], lambda x: x IS NOT NULL) AS g FROM part)""")
def completeness(spark, sf_dir):
    parts = items.completeness({"size": F.col("p_size") > 10, "price": F.col("p_retailprice") > 950, "bolt": F.col("p_name").contains("bolt")})
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(k) for k, c in parts.items())).withColumn("missing", F.array_join("missing", ","))


@query("""WITH s AS (SELECT l_orderkey, floor(l_quantity / 3 * 2 + 0.5) / 2.0 AS v, sum(l_linenumber) AS w, min(l_partkey * 100 + l_linenumber) AS place FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN v = 0 THEN 10.0 ELSE v END AS mode FROM (SELECT l_orderkey, arg_max(v, (w, -place, -v)) AS v FROM s GROUP BY l_orderkey)""")
def modal_quantity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_partkey") * 100 + F.col("l_linenumber"))
    return items.weighted_mode(rows, "l_orderkey", F.col("l_quantity") / 3, F.col("l_linenumber"), "at")


# ---- skills, levels and tenses

_SKILLS = """w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT unnest([w[1], w[2] || ' ' || w[3], w[4] || ' ' || w[5] || ' ' || w[6]]) AS skill FROM w WHERE len(w) >= 6)"""


def _skills(spark, sf_dir):
    """Words and phrases that stand in benchmark items, as a table of skills."""
    w = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w")).where("size(w) >= 6")
    runs = F.array(F.get("w", F.lit(0)), *(F.array_join(F.slice("w", a, n), " ") for a, n in ((2, 2), (4, 3))))
    return w.select(F.explode(runs).alias("skill")).distinct()


@query(f"""WITH {_SKILLS}, d AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents)
SELECT DISTINCT doc_id, skill FROM d, s WHERE contains(t, ' ' || skill || ' ') OR contains(t, ' ' || skill || ',') OR contains(t, ' ' || skill || '.')""")
def known_skills(spark, sf_dir):
    return skills.known_skills(table(spark, sf_dir, "documents"), "doc_id", "text", _skills(spark, sf_dir))


@query(f"""WITH {_SKILLS}, f AS (SELECT skill, CASE WHEN length(skill) > 8 THEN 'en' ELSE 'fr' END AS lang FROM s),
n AS (SELECT lang, count(*) AS n FROM f GROUP BY lang),
d AS (SELECT doc_id, lang, ' ' || regexp_replace(regexp_replace(lower(text), '[^a-z0-9+#./ -]', ' ', 'g'), '\\s+', ' ', 'g') || ' ' AS t FROM documents),
h AS (SELECT doc_id, count(*) AS hits, string_agg(skill, ',' ORDER BY skill) AS present FROM d JOIN f ON d.lang = f.lang AND (contains(t, ' ' || skill || ' ') OR contains(t, ' ' || skill || 's ')) GROUP BY doc_id)
SELECT d.doc_id, d.lang, CAST(coalesce(n.n, 0) AS INTEGER) AS n_wanted, coalesce(present, '') AS present, CAST(coalesce(n.n, 0) - coalesce(hits, 0) AS INTEGER) AS n_missing
FROM d LEFT JOIN n ON d.lang = n.lang LEFT JOIN h ON d.doc_id = h.doc_id""")
def field_skills(spark, sf_dir):
    named = _skills(spark, sf_dir).withColumn("lang", F.when(F.length("skill") > 8, "en").otherwise("fr"))
    out = skills.field_skills(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", named)
    return out.select("doc_id", "lang", "n_wanted", F.array_join("present", ",").alias("present"), F.size("missing").alias("n_missing"))


TITLES = ("Vice President", "Head of Data", "Junior Analyst", "Engineer", "graduate scheme", "Headmaster")
_TITLE = f"([{', '.join(repr(t) for t in TITLES)}])[1 + turn % {len(TITLES)}]"


@query(f"""WITH t AS (SELECT conv_id, turn, lower({_TITLE}) AS t, length(text) - 40 AS m, role = 'user' AS x FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '{skills.EXECUTIVE}') THEN 'executive'
  WHEN regexp_matches(t, '{skills.LEADING}') THEN CASE WHEN m >= 96 THEN 'executive' ELSE 'senior' END
  WHEN m <= 0 AND NOT x THEN 'student' WHEN regexp_matches(t, '{skills.STARTING}') AND m < 30 THEN 'entry'
  WHEN m >= 120 THEN 'senior' WHEN m >= 36 THEN 'mid' WHEN m > 0 OR x THEN 'entry' ELSE 'student' END AS level FROM t""")
def seniority(spark, sf_dir):
    """Levels of made-up careers: a title by turn, months by the length of the text."""
    months = F.length("text") - 40
    title = F.get(F.array(*map(F.lit, TITLES)), (F.col("turn") % len(TITLES)).cast("int"))
    level = skills.seniority(title, months, dated=months > 0, education=F.lit(True), experience=F.col("role") == "user")
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", level.alias("level"))


_VERBS = ", ".join(repr(v) for v in resume.VERBS)


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents UNION ALL SELECT -1, v || e FROM (SELECT unnest([{_VERBS}]) AS v), (SELECT unnest(['', 's', 'ed', 'ing', 'ly']) AS e)),
t AS (SELECT doc_id, CASE WHEN w IN ({", ".join(repr(v) for v in resume.IRREGULAR)}) THEN 'past' WHEN suffix(w, 'ing') THEN 'gerund' WHEN suffix(w, 'ed') THEN 'past'
  WHEN w IN ({_VERBS}) OR (suffix(w, 's') AND w[:-2] IN ({_VERBS})) THEN 'present' ELSE 'unknown' END AS tense FROM w)
SELECT doc_id, tense, count(*) AS n FROM t GROUP BY ALL""")
def verb_tenses(spark, sf_dir):
    """Tenses of the words of each document, and under -1 those of the verbs with usual endings."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w"))
    forms = spark.createDataFrame([(-1, v + e) for v in resume.VERBS for e in ("", "s", "ed", "ing", "ly")], "doc_id long, w string")
    return words.union(forms).groupBy("doc_id", resume.tense(F.col("w")).alias("tense")).agg(F.count("*").alias("n"))
