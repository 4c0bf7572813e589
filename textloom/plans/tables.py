"""Queries over events, sales and small dimension tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import encoding, numeric
from ..functions import text as T
from ..operators import delimited, jsons, relations
from ..streaming import windows
from .registry import query, table

@query("""SELECT user_id, event_id, hits, hits > 12 AS limited FROM (SELECT user_id, event_id,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS hits FROM events)""")
def rate_limit(spark, sf_dir):
    return windows.rate_limit(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts").select("user_id", "event_id", "hits", "limited")


@query("""SELECT event_id, CAST(ts AS DATE) AS day, round(spent, 4) AS spent, spent >= 100 AS over FROM (SELECT *, coalesce(sum(value) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent FROM events)""")
def daily_budget(spark, sf_dir):
    return windows.daily_budget(table(spark, sf_dir, "events"), "ts", "value", 100.0, "event_id").select("event_id", "day", F.round("spent", 4).alias("spent"), "over")


@query("""SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events) WHERE after IS NULL OR epoch_us(after) - epoch_us(ts) >= 3600000000""")
def debounced_events(spark, sf_dir):
    return windows.debounce(table(spark, sf_dir, "events"), "user_id", "ts", 3_600_000).select("user_id", "event_id")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def usage_by_hour(spark, sf_dir):
    return windows.usage_by_window(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("SELECT user_id, event_type, min(ts) AS ts, count(*) AS asked FROM events GROUP BY ALL")
def first_answers(spark, sf_dir):
    return windows.first_answers(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@query("""WITH k AS (SELECT '$.' || unnest(json_keys(props)) AS shape, props FROM events), t AS (SELECT shape, CASE json_type(props, shape) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS t FROM k)
SELECT shape, array_to_string(list_sort(list(DISTINCT t)), ',') AS types, count(*) AS n, count(*) < (SELECT count(*) FROM events) AS optional FROM t GROUP BY shape UNION ALL SELECT '$', 'object', count(*), false FROM events""")
def json_shape(spark, sf_dir):
    return jsons.shape(table(spark, sf_dir, "events"), "event_id", "props").withColumn("types", F.array_join("types", ","))


@query("""SELECT event_id, CAST(octet_length(encode(props)) AS INTEGER) AS n_bytes, CASE WHEN len(json_keys(props)) > 0 THEN 2 ELSE 1 END AS depth, len(json_keys(props)) AS keys, 0 AS arrays, 1 AS objects, 0 AS nulls, 'object' AS root FROM events""")
def json_stats(spark, sf_dir):
    return jsons.stats(table(spark, sf_dir, "events"), "event_id", "props")


@query("""WITH e AS (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
l AS (SELECT event_id, before AS j, unnest(json_keys(before)) AS k FROM e WHERE before IS NOT NULL), r AS (SELECT event_id, props AS j, unnest(json_keys(props)) AS k FROM e WHERE before IS NOT NULL),
b AS (SELECT event_id, k, l.j AS lj, r.j AS rj, json_extract_string(l.j, '$.' || k) AS "left", json_extract_string(r.j, '$.' || k) AS "right" FROM l FULL JOIN r USING (event_id, k))
SELECT event_id, '$.' || k AS path, CASE WHEN lj IS NULL THEN 'added' WHEN rj IS NULL THEN 'removed' ELSE 'changed' END AS kind, "left", "right" FROM b WHERE lj IS NULL OR rj IS NULL OR "left" <> "right" """)
def json_diff(spark, sf_dir):
    """Each event's properties against those of the user's event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select("event_id", "props", F.lag("props").over(w).alias("before")).where("before is not null")
    return jsons.diff(pairs.select("event_id", F.col("before").alias("props")), pairs.select("event_id", "props"), "event_id", "props")


@query("""WITH m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s FROM orders), i AS (SELECT o_custkey, s, s + 2 AS e FROM m),
b AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum((before IS NULL OR s > before + 1)::INT) OVER (PARTITION BY o_custkey ORDER BY s, e RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM b),
x AS (SELECT o_custkey, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL), y AS (SELECT *, s - lag(e) OVER (PARTITION BY o_custkey ORDER BY s) - 1 AS gap FROM x)
SELECT o_custkey, CAST(sum(e - s + 1) AS BIGINT) AS months, count(*) AS n_spans, count(*) FILTER (gap >= 6) AS n_gaps FROM y GROUP BY o_custkey""")
def active_months(spark, sf_dir):
    """An order makes its customer active for three months."""
    start = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    spans = table(spark, sf_dir, "orders").select("o_custkey", start.alias("s"), (start + 2).alias("e"))
    return relations.merge_intervals(spans, "o_custkey", "s", "e")


@query("""SELECT o_orderkey, floor(o_totalprice * 15.0 / 100 * 100.0 + 0.5) / 100.0 AS "of", floor(15.0 / nullif(o_totalprice, 0) * 100 * 10000.0 + 0.5) / 10000.0 AS is_what,
  floor((20000.0 - o_totalprice) / nullif(abs(o_totalprice), 0) * 100 * 100.0 + 0.5) / 100.0 AS change, floor(o_totalprice * (1 + 15.0 / 100) * 100.0 + 0.5) / 100.0 AS added FROM orders""")
def percentages(spark, sf_dir):
    p, fifteen = F.col("o_totalprice"), F.lit(15.0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        T.half_up(numeric.percent("of", fifteen, p), 2).alias("of"),
        T.half_up(numeric.percent("is-what", fifteen, p), 4).alias("is_what"),
        T.half_up(numeric.percent("change", p, F.lit(20000.0)), 2).alias("change"),
        T.half_up(numeric.percent("add", fifteen, p), 2).alias("added"),
    )


@query("""SELECT CASE WHEN p_size >= 40 THEN '40-50' WHEN p_size >= 30 THEN '30-39' WHEN p_size >= 20 THEN '20-29' ELSE 'under 20' END AS bucket, count(*) AS n,
  floor(avg(least(1.0, greatest(0.0, (p_size - 10) / 30.0))) * 1000.0 + 0.5) / 1000.0 AS credit FROM part GROUP BY 1""")
def size_histogram(spark, sf_dir):
    bucket = F.when(F.col("p_size") >= 40, "40-50").when(F.col("p_size") >= 30, "30-39").when(F.col("p_size") >= 20, "20-29").otherwise("under 20")
    return table(spark, sf_dir, "part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), T.half_up(F.avg(numeric.band(F.col("p_size"), 10, 40)), 3).alias("credit"))


@query("""WITH s AS (SELECT p_partkey, p_name, p_retailprice, CASE WHEN lower(p_name) = 'bolt' THEN 4 WHEN starts_with(lower(p_name), 'bolt') THEN 3 WHEN contains(lower(p_name), ' bolt') THEN 2 WHEN contains(lower(p_name), 'bolt') THEN 1 ELSE 0 END AS m FROM part)
SELECT p_partkey, p_name, m AS "match" FROM s WHERE m > 0 ORDER BY m DESC, p_retailprice DESC, p_name LIMIT 12""")
def part_search(spark, sf_dir):
    return relations.search(table(spark, sf_dir, "part"), "p_name", "bolt", "p_retailprice", key="p_partkey").select("p_partkey", "p_name", "match")


LINKS = "SELECT DISTINCT l_partkey AS src, l_suppkey % 50 AS dst FROM lineitem"


@query(f"""WITH n AS (SELECT s_suppkey AS id FROM supplier), e AS ({LINKS}), i AS (SELECT dst AS id, count(DISTINCT src) AS i FROM e WHERE src <> dst GROUP BY 1), o AS (SELECT src AS id, count(DISTINCT dst) AS o FROM e GROUP BY 1)
SELECT n.id, coalesce(i, 0) + 2 AS inbound, coalesce(o, 0) + 2 AS outbound, i IS NULL AS is_orphan, coalesce(i, 0) + 2 < 5 AS is_weak FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def link_audit(spark, sf_dir):
    """Parts link to suppliers; both have numbers from one range here."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") % 50).alias("dst"))
    return relations.link_audit(nodes, edges, "id", "src", "dst")


@query("SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def broken_links(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return relations.broken_links(nodes, edges, "id", "src", "dst")


@query("""SELECT c_custkey, sha1(c_name) AS sha1, sha256(c_name) AS sha256, to_base64(encode(c_name)) AS b64, rtrim(translate(to_base64(encode(c_name)), '+/', '-_'), '=') AS b64_url, c_name AS back,
  url_encode(c_name) AS component, replace(url_encode(c_name), '%20', '+') AS form FROM customer""")
def encodings(spark, sf_dir):
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        encoding.digest(c, 1).alias("sha1"),
        encoding.digest(c).alias("sha256"),
        encoding.base64(c).alias("b64"),
        encoding.base64(c, url_safe=True).alias("b64_url"),
        encoding.unbase64(encoding.base64(c, url_safe=True)).alias("back"),
        encoding.url_encode(c).alias("component"),
        encoding.url_encode(c, "form").alias("form"),
    )


@query(r"""SELECT s_suppkey, s_suppkey || ',' || CASE WHEN regexp_matches(s_name, '[,"\r\n]') THEN '"' || replace(s_name, '"', '""') || '"' ELSE s_name END AS csv, s_suppkey || chr(9) || replace(s_name, chr(9), ' ') AS tsv,
  'INSERT INTO suppliers (s_suppkey, s_name) VALUES (' || s_suppkey || ', ''' || replace(s_name, '''', '''''') || ''');' AS sql FROM supplier""")
def delimited_rows(spark, sf_dir):
    cells = [F.col("s_suppkey"), F.col("s_name")]
    return table(spark, sf_dir, "supplier").select("s_suppkey", delimited.csv_row(cells).alias("csv"), delimited.tsv_row(cells).alias("tsv"), delimited.sql_insert("Suppliers", ["s_suppkey", "s_name"], cells).alias("sql"))


@query("""WITH w AS (SELECT greatest(max(length(CAST(n_nationkey AS VARCHAR))), 11) AS a, greatest(max(length(n_name)), 6) AS b FROM nation),
r AS (SELECT row_number() OVER (ORDER BY n_nationkey) + 1 AS place, CAST(n_nationkey AS VARCHAR) AS x, n_name AS y FROM nation UNION ALL SELECT 0, 'n_nationkey', 'n_name' UNION ALL SELECT 1, repeat('-', a), repeat('-', b) FROM w)
SELECT CAST(place AS INTEGER) AS place, '| ' || rpad(x, a::INT, ' ') || ' | ' || rpad(y, b::INT, ' ') || ' |' AS line FROM r, w""")
def markdown_table(spark, sf_dir):
    return delimited.markdown(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], ["n_nationkey"])


@query("""SELECT *, floor(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY o_orderpriority) * 100.0 + 0.5) / 100.0 AS pct FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)""")
def status_shares(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    share = T.half_up(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("o_orderpriority")), 2)
    return counts.withColumn("pct", share)


@query(f"""WITH n AS (SELECT s_suppkey AS id FROM supplier), e AS ({LINKS}), i AS (SELECT dst AS id, count(DISTINCT src) AS i FROM e WHERE src <> dst GROUP BY 1), o AS (SELECT src AS id, count(DISTINCT dst) AS o FROM e GROUP BY 1),
a AS (SELECT n.id, coalesce(i, 0) AS i, coalesce(o, 0) + 2 AS o FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id)), b AS (SELECT count(*) AS broken FROM (SELECT DISTINCT src, dst FROM e WHERE dst NOT IN (SELECT id FROM n)))
SELECT count(*) AS nodes, count(*) FILTER (i = 0) AS orphans, count(*) FILTER (i BETWEEN 1 AND 2) AS weak, count(*) FILTER (o < 8) AS few_out, count(*) FILTER (o > 12) AS many_out, any_value(broken) AS broken, count(*) FILTER (i = 0) > 0 OR any_value(broken) > 0 AS failed FROM a, b""")
def link_bands(spark, sf_dir):
    """The audit of link_audit in one row."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") % 50).alias("dst"))
    broken = relations.broken_links(nodes, edges, "id", "src", "dst").agg(F.count("*"))
    return relations.link_bands(relations.link_audit(nodes, edges, "id", "src", "dst"), broken)
