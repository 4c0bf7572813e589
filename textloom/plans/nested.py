"""Queries over nested JSON, one document an order, made by one SQL expression that both engines read.

The twins walk the documents by DuckDB's json_tree, so that no answer is written down.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import json_tables
from ..operators import json_yaml as yaml
from .registry import query, spread, table

_KEY = "CAST(o_orderkey AS STRING)"
#: A list of mixed records in an object, a root list, an object alone, empty containers, names that need quoting.
DOC = f"""CASE WHEN o_orderkey % 7 = 5 THEN '[{{"id":' || {_KEY} || ',"tags":["x",' || CAST(o_custkey AS STRING) || ']}},[' || {_KEY} || ',{{"q":true}}],"' || o_orderstatus || '",null]'
WHEN o_orderkey % 7 = 6 THEN '{{"total":' || CAST(o_custkey AS STRING) || '.5,"lines":[1,2],"none":[],"address":{{"city":"' || o_orderpriority || '"}},"billing":{{"city":"x"}}}}'
ELSE '{{ "meta": {{"k" : ' || {_KEY} || '}},"empty":[],"items":[{{"id":' || {_KEY} || ',"a b":{{"x":"' || o_orderpriority || '","y":null}},"tags":["p",null,{{"z":' || CAST(o_custkey AS STRING) || '}}],"e":{{}}}}'
  || CASE WHEN o_orderkey % 2 = 0 THEN ',5,{{"id":"' || o_orderstatus || '","late":false,"tags":[]}}' ELSE '' END || ',{{"a b":{{"x":"q","y":"w"}},"more":[[1],["two",3]]}}],"later":[{{"no":1}}]}}' END"""


def documents(spark, sf_dir):
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    return orders.select("o_orderkey", F.expr(DOC).alias("doc"))


_TREE = f"""d AS (SELECT o_orderkey, CAST({DOC} AS JSON) AS j FROM orders),
n AS (SELECT o_orderkey, t.key AS name, t.value AS v, t.type AS kind, t.id AS pos, t.parent AS up, t.fullkey AS fk, t.path AS above, json_type(j) AS root FROM d, json_tree(j) t)"""
_PLAIN = "CASE kind WHEN 'VARCHAR' THEN v->>'$' WHEN 'NULL' THEN '' WHEN 'OBJECT' THEN '' WHEN 'ARRAY' THEN '' ELSE CAST(v AS VARCHAR) END"
_CELLS = rf"""{_TREE},
lists AS (SELECT l.o_orderkey, l.fk, l.pos FROM n l WHERE l.kind = 'ARRAY' AND l.above = '$' AND l.fk <> '$' AND l.root = 'OBJECT' AND EXISTS (SELECT 1 FROM n c WHERE c.o_orderkey = l.o_orderkey AND c.up = l.pos AND c.kind = 'OBJECT')),
src AS (SELECT o_orderkey, arg_min(fk, pos) AS src FROM lists GROUP BY o_orderkey),
s AS (SELECT n.*, CASE WHEN root = 'ARRAY' THEN '$' ELSE src END AS src FROM n LEFT JOIN src USING (o_orderkey)),
x AS (SELECT *, CASE WHEN src IS NULL THEN substr(fk, 2) ELSE regexp_replace(substr(fk, length(src) + 1), '^\[\d+\]', '') END AS rest, CASE WHEN src IS NULL THEN 0 ELSE CAST(regexp_extract(substr(fk, length(src) + 1), '^\[(\d+)\]', 1) AS INTEGER) END AS record
  FROM s WHERE (src IS NULL OR (starts_with(fk, src || '[')))),
c AS (SELECT o_orderkey, record, pos, coalesce(src, '$') AS src, CASE WHEN rest = '' AND kind NOT IN ('OBJECT', 'ARRAY') THEN 'value' ELSE regexp_replace(regexp_replace(rest, '\."([^"]*)"', '.\1', 'g'), '^\.', '') END AS path, {_PLAIN} AS value,
  1 + len(regexp_extract_all(rest, '\[\d+\]|\.("[^"]*"|[^.\[]+)')) AS level FROM x WHERE kind NOT IN ('OBJECT', 'ARRAY') OR json_array_length(v) = 0 AND kind = 'ARRAY' OR kind = 'OBJECT' AND len(json_keys(v)) = 0)"""


@query(f"WITH {_CELLS} SELECT o_orderkey, record, path, value, src AS source FROM c")
def nested_flatten(spark, sf_dir):
    """The cells of each document's table, a column an element of lists."""
    return json_tables.cells(documents(spark, sf_dir), "o_orderkey", "doc").select("o_orderkey", "record", "path", "value", "source")


@query(f"""WITH {_CELLS}, h AS (SELECT o_orderkey, path, min((record, pos)) AS first FROM c GROUP BY ALL), t AS (SELECT o_orderkey, list(path ORDER BY first) AS columns FROM h GROUP BY o_orderkey),
r AS (SELECT o_orderkey, record, map_from_entries(list((path, value))) AS m, count(*) AS n FROM c GROUP BY ALL)
SELECT o_orderkey, record, array_to_string(columns, '|') AS columns, array_to_string(list_transform(columns, lambda c: coalesce(m[c], '')), '|') AS cells, n < len(columns) AS missing FROM r JOIN t USING (o_orderkey)""")
def nested_tables(spark, sf_dir):
    """Rows of each document's table under the union of its records' names."""
    rows = json_tables.table_rows(json_tables.tables(documents(spark, sf_dir), "o_orderkey", "doc"), "o_orderkey")
    return rows.select("o_orderkey", "record", F.array_join("columns", "|").alias("columns"), F.array_join("cells", "|").alias("cells"), "missing")


@query(f"""WITH {_CELLS}, h AS (SELECT o_orderkey, path, min((record, pos)) AS first FROM c GROUP BY ALL), k AS (SELECT o_orderkey, count(*) AS n_columns, coalesce(string_agg(path, '|' ORDER BY first) FILTER (first[1] > 0), '') AS late FROM h GROUP BY o_orderkey),
r AS (SELECT o_orderkey, record, count(*) AS n FROM c GROUP BY ALL), q AS (SELECT o_orderkey, count(*) AS n_rows, count(*) FILTER (n < n_columns) AS sparse_rows FROM r JOIN k USING (o_orderkey) GROUP BY ALL)
SELECT o_orderkey, min(src) AS source, any_value(n_rows) AS n_rows, CAST(any_value(n_columns) AS INTEGER) AS n_columns, any_value(sparse_rows) AS sparse_rows, any_value(late) AS late, CAST(max(level) AS INTEGER) AS depth FROM c JOIN k USING (o_orderkey) JOIN q USING (o_orderkey) GROUP BY o_orderkey""")
def nested_summaries(spark, sf_dir):
    """Where records were found, rows, columns, sparse rows, late columns and depth of each document's table."""
    return json_tables.table_summary(json_tables.tables(documents(spark, sf_dir), "o_orderkey", "doc"), "o_orderkey").withColumn("late", F.array_join("late", "|"))


@query(rf"""WITH {_TREE}, p AS (SELECT o_orderkey, pos, CASE kind WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS t,
  regexp_replace(regexp_replace(fk, '\[\d+\]', '[]', 'g'), '\."([^"]*)"', '.\1', 'g') AS path FROM n),
t AS (SELECT o_orderkey, path, t, min(pos) AS first, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT o_orderkey, path, string_agg(t, '|' ORDER BY first) AS types, sum(n) AS n FROM t GROUP BY ALL),
o AS (SELECT o_orderkey, path AS up, n AS times FROM t WHERE t = 'object')
SELECT o_orderkey, path, types, coalesce(NOT suffix(path, '[]') AND n < times, false) AS optional FROM m LEFT JOIN o ON m.o_orderkey = o.o_orderkey AND up = regexp_replace(path, '(\[\]|\.[^.\[]+)$', '')""".replace("SELECT o_orderkey, path, types, coalesce", "SELECT m.o_orderkey, path, types, coalesce"))
def nested_shapes(spark, sf_dir):
    """The merged shape of each document: types of each place, and whether some object lacks it."""
    return json_tables.shape_rows(json_tables.shapes(documents(spark, sf_dir), "o_orderkey", "doc"), "o_orderkey")


@query()
def shape_declarations(spark, sf_dir):
    """TypeScript declarations of each document."""
    return json_tables.written_declarations(json_tables.merged_shapes(documents(spark, sf_dir), "o_orderkey", "doc"), "o_orderkey")


@query(rf"""WITH {_TREE} SELECT o_orderkey, CAST(any_value(octet_length(encode(CAST(j AS VARCHAR)))) AS INTEGER) AS n_bytes, CAST(any_value(octet_length(encode(CAST(json(j) AS VARCHAR)))) AS INTEGER) AS minified_bytes, CAST(max(len(regexp_extract_all(fk, '\[\d+\]|\.("[^"]*"|[^.\[]+)'))) + 1 AS INTEGER) AS depth,
  count(*) FILTER (fk <> '$' AND NOT regexp_matches(fk, '\[\d+\]$')) AS keys, count(*) FILTER (kind = 'ARRAY') AS arrays, count(*) FILTER (kind = 'OBJECT') AS objects, count(*) FILTER (kind = 'NULL') AS nulls, lower(any_value(root)) AS root
  FROM n JOIN d USING (o_orderkey) GROUP BY o_orderkey""")
def nested_stats(spark, sf_dir):
    return json_tables.stats(documents(spark, sf_dir), "o_orderkey", "doc")


@query(r"""WITH n AS (SELECT event_id, t.key AS path, t.value AS v, t.type AS kind FROM events, json_tree(CAST(props AS JSON)) t WHERE json_valid(props) AND t.fullkey <> '$')
SELECT event_id, 0 AS record, path, CASE kind WHEN 'VARCHAR' THEN v->>'$' WHEN 'NULL' THEN '' ELSE CAST(v AS VARCHAR) END AS value FROM n""")
def json_flatten(spark, sf_dir):
    return json_tables.cells(table(spark, sf_dir, "events"), "event_id", "props").select("event_id", "record", "path", "value")


@query(r"""SELECT event_id, 0 AS record, coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), '') AS k FROM events WHERE json_valid(props)""")
def events_wide(spark, sf_dir):
    """All events' properties as one table with a column for each name."""
    return json_tables.wide(json_tables.cells(table(spark, sf_dir, "events"), "event_id", "props"), "event_id")


@query(r"""WITH k AS (SELECT event_id, t.key AS k, t.value AS v, t.id AS pos FROM events, json_tree(CAST(props AS JSON)) t WHERE t.fullkey <> '$')
SELECT event_id, string_agg(k || ': ' || CAST(v AS VARCHAR), chr(10) ORDER BY pos) || chr(10) AS output FROM k GROUP BY event_id""")
def json_yaml(spark, sf_dir):
    return yaml.to_yaml(table(spark, sf_dir, "events"), "event_id", "props").select("event_id", "output")


#: A line for each leaf and label; the first line of a list's element has a dash. No text here needs more than quotes.
_YAML_SQL = rf"""{_TREE}, s AS (SELECT *, regexp_extract_all(fk, '\[\d+\]|\.(?:"[^"]*"|[^.\[]+)') AS steps, kind NOT IN ('OBJECT', 'ARRAY') OR kind = 'ARRAY' AND json_array_length(v) = 0 OR kind = 'OBJECT' AND len(json_keys(v)) = 0 AS leaf FROM n),
w AS (SELECT *, len(steps) > 0 AND NOT starts_with(steps[-1], '[') AS member FROM s),
o AS (SELECT o_orderkey, pos, steps, leaf, member, name, kind, v, CASE WHEN member THEN len(steps) - 1 ELSE len(steps) END AS levels FROM w WHERE leaf OR member),
items AS (SELECT i.o_orderkey, len(i.steps) AS level, i.steps AS item, min(o.pos) AS first FROM w i JOIN o ON o.o_orderkey = i.o_orderkey AND o.steps[1:len(i.steps)] = i.steps WHERE len(i.steps) > 0 AND NOT i.member GROUP BY ALL),
p AS (SELECT o.o_orderkey, o.pos, o.levels, o.member, o.name, o.leaf, o.kind, o.v, o.steps, coalesce(list(i.level) FILTER (i.level IS NOT NULL), []) AS dashes FROM o LEFT JOIN items i ON i.o_orderkey = o.o_orderkey AND i.first = o.pos GROUP BY ALL),
l AS (SELECT o_orderkey, pos, coalesce(array_to_string(list_transform(range(1, levels + 1), lambda k: CASE WHEN list_contains(dashes, k) THEN '- ' ELSE '  ' END), ''), '') || CASE WHEN NOT member THEN '' WHEN regexp_matches(name, '^(?i:y|n|yes|no|on|off|null|true|false)$') THEN '''' || name || ''':' ELSE name || ':' END
  || CASE WHEN NOT leaf THEN '' ELSE CASE WHEN member THEN ' ' ELSE '' END || CASE kind WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(v->>'$', '^(?i:y|n|yes|no|on|off|null|true|false)$') THEN '''' || (v->>'$') || '''' ELSE v->>'$' END ELSE CAST(v AS VARCHAR) END END AS line FROM p)
SELECT o_orderkey, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS output, CAST(count(*) AS INTEGER) AS n_lines FROM l GROUP BY o_orderkey"""


@query(f"WITH {_YAML_SQL}")
def nested_yaml(spark, sf_dir):
    return yaml.to_yaml(documents(spark, sf_dir), "o_orderkey", "doc").select("o_orderkey", "output", "n_lines")


@query(rf"""WITH {_CELLS}, h AS (SELECT o_orderkey, path, min((record, pos)) AS first FROM c GROUP BY ALL), t AS (SELECT o_orderkey, list(path ORDER BY first) AS columns FROM h GROUP BY o_orderkey),
r AS (SELECT o_orderkey, record, map_from_entries(list((path, value))) AS m FROM c GROUP BY ALL),
q AS (SELECT o_orderkey, record, list_transform(columns, lambda c: coalesce(m[c], '')) AS cells FROM r JOIN t USING (o_orderkey)),
l AS (SELECT o_orderkey, record, array_to_string(list_transform(cells, lambda x: CASE WHEN regexp_matches(x, '[;"\r\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), ';') AS line FROM q)
SELECT o_orderkey, chr(65279) || array_to_string(any_value(columns), ';') || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY record) AS output FROM l JOIN t USING (o_orderkey) GROUP BY o_orderkey""")
def nested_csv(spark, sf_dir):
    """Each document's table as a delimited file's text, with a byte order mark and CRLF."""
    return json_tables.table_files(json_tables.tables(documents(spark, sf_dir), "o_orderkey", "doc"), "o_orderkey", delimiter=";", bom=True, crlf=True)
