"""Delimited text inside columns: detection, parsing, and writing as CSV, TSV, Markdown or SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CANDIDATES = (",", "\t", ";", "|", " ")


def _unquoted(line: Column) -> Column:
    return F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, r'"(?:[^"]|"")*"', "")).otherwise(line)


def _fields(bare: Column, delimiter: str) -> Column:
    """Fields of a line without its quoted parts: delimiters, each of one byte, plus one."""
    return F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, delimiter, confidence, columns: the candidate that splits most of the first 50 lines like the first."""
    lines = F.slice(F.filter(T.lines(F.col(text)), lambda x: ~T.is_blank(x)), 1, 50)

    def score(d: str, bare: Column) -> Column:
        def of(n: Column) -> Column:
            first = F.get(n, F.lit(0))
            good = first >= 2
            share = T.bound(first, lambda k: F.size(F.filter(n, lambda x: x == k)) / F.size(n))
            return F.struct(F.when(good, share).otherwise(0.0).alias("confidence"), F.when(good, first).otherwise(0).alias("columns"), F.lit(-CANDIDATES.index(d)).alias("early"), F.when(good, F.lit(d)).otherwise(F.lit(",")).alias("delimiter"))

        return T.bound(F.transform(bare, lambda x: _fields(x, d)), of)

    # lines and their fields are bound: a lambda would split the text again for each line that it compares
    best = T.bound(F.transform(lines, _unquoted), lambda bare: F.when(F.size(bare) > 0, F.array_max(F.array(*(score(d, bare) for d in CANDIDATES)))))
    return df.select(key, best.alias("best")).select(key, F.coalesce("best.delimiter", F.lit(",")).alias("delimiter"), F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("best.columns", F.lit(0)).alias("columns"))


def _parse(text: str, delimiter: str) -> list[list[str]]:
    """RFC 4180 with line ends of any kind; text after a closing quote is appended; no empty last row."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    rows: list[list[str]] = []
    row: list[str] = []
    at, n = 0, len(text)
    while at < n:
        field = ""
        if text[at] == '"':
            at += 1
            while at < n:
                z = text.find('"', at)
                z = n if z < 0 else z
                field += text[at:z]
                if text[z : z + 2] != '""':
                    at = z + 1
                    break
                field += '"'
                at = z + 2
        z = min((p for p in (text.find(delimiter, at), text.find("\n", at)) if p >= 0), default=n)
        row.append(field + text[at:z])
        at = z + 1
        if z >= n or text[z] == "\n":
            rows.append(row)
            row = []
        elif at >= n:
            row.append("")
    if row:
        rows.append(row)
    return rows


def parse(df: DataFrame, key: str, text: str, delimiter: str | Column = ",") -> DataFrame:
    """key, row_no, cells of each row of each text; a null text gives none."""
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), (F.lit(delimiter) if isinstance(delimiter, str) else delimiter).alias("_d"))

    def run(batches):
        for b in batches:
            who, number, cells = [], [], []
            for i, (t, d) in enumerate(zip(b.column("_text").to_pylist(), b.column("_d").to_pylist(), strict=True)):
                for k, row in enumerate(_parse(t, d) if t else ()):
                    who.append(i)
                    number.append(k)
                    cells.append(row)
            yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(who, pa.int64())), pa.array(number, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["_key", "row_no", "cells"])

    return slim.mapInArrow(run, f"_key {kind}, row_no int, cells array<string>").withColumnRenamed("_key", key)


def table_rows(rows: DataFrame, key: str, *, with_header: bool = True, trim: bool = True) -> DataFrame:
    """key, row_no (from 1, without the header), names, cells of parsed rows; rows of one blank field don't count.

    names are the first row's cells, or "Column 1", "Column 2" and so on where there is no header.
    """
    cells = F.transform("cells", T.trim) if trim else F.col("cells")
    full = rows.where(~((F.size("cells") == 1) & T.is_blank(F.get("cells", F.lit(0))))).select(key, "row_no", cells.alias("cells"))
    w = Window.partitionBy(key)
    nth = F.row_number().over(w.orderBy("row_no"))
    numbered = F.transform(F.sequence(F.lit(1), F.size("_first")), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    out = full.withColumns({"_nth": nth, "_first": F.min_by("cells", "row_no").over(w)})
    names = F.col("_first") if with_header else numbered
    skip = 1 if with_header else 0
    return out.where(F.col("_nth") > skip).select(key, (F.col("_nth") - skip).alias("row_no"), names.alias("names"), "cells")


def ragged(rows: DataFrame, key: str) -> DataFrame:
    """key, n_rows, width (of the first row), n_ragged; rows of one blank field don't count."""
    full = rows.where(~((F.size("cells") == 1) & T.is_blank(F.get("cells", F.lit(0)))))
    widths = full.groupBy(key, F.size("cells").alias("w")).agg(F.count("*").alias("n"), F.min("row_no").alias("at"))
    found = widths.groupBy(key).agg(F.sum("n").alias("n_rows"), F.min_by("w", "at").alias("width"), F.min_by("n", "at").alias("like"))
    return found.select(key, "n_rows", "width", (F.col("n_rows") - F.col("like")).alias("n_ragged"))


def parse_line(c: Column, delimiter: str = ",") -> Column:
    """The cells of one line; quotes are doubled inside quotes, and what follows a closing quote is appended."""
    d = rf"\x{{{ord(delimiter):X}}}"
    fields = F.regexp_extract_all(F.concat(F.lit(delimiter), c), F.lit(rf'(?s){d}("(?:[^"]|"")*(?:"[^{d}]*)?|[^{d}]*)'), 1)

    def plain(x: Column) -> Column:
        inner = F.regexp_extract(x, r'(?s)^"((?:[^"]|"")*)', 1)
        rest = F.substring(x, F.length(inner) + 3, F.length(x))
        return F.when(x.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(x)

    return F.transform(fields, plain)


def json_row(names: list[str], cells: list[Column]) -> Column:
    """One record of a JSON file of objects, indented as within its list; cells are texts, a missing one ''."""
    import json

    lines = [F.concat(F.lit(f"    {json.dumps(n, ensure_ascii=False)}: "), _json_text(c)) for n, c in zip(names, cells, strict=True)]
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *lines), F.lit("\n  }"))


def json_array_row(cells: list[Column]) -> Column:
    """One row of a JSON file of arrays."""
    return F.concat(F.lit("  [\n"), F.concat_ws(",\n", *(F.concat(F.lit("    "), _json_text(c)) for c in cells)), F.lit("\n  ]"))


def _json_text(c: Column) -> Column:
    whole = F.to_json(F.struct(F.coalesce(c.cast("string"), F.lit("")).alias("v")))  # {"v":...}
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def csv_row(cells: list[Column], guard: bool = False, delimiter: str = ",") -> Column:
    """A line of CSV, or of another delimiter; guarded cells can't be read as formulas."""

    def one(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        if guard:
            c = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
        special = c.contains(delimiter) | c.rlike('["\r\n]')
        return F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.concat_ws(delimiter, *map(one, cells))


def tsv_row(cells: list[Column]) -> Column:
    return F.concat_ws("\t", *(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\t"), F.lit(" ")) for c in cells))


def sql_insert(name: str, columns: list[str], cells: list[Column]) -> Column:
    """An INSERT statement; empty cells are NULL, numbers bare."""

    def ident(x: str) -> str:
        import re

        x = re.sub("[^a-zA-Z0-9_]+", "_", x.strip()).lower()
        return ("_" + x if x[:1].isdigit() else x) or "column"

    def value(c: Column) -> Column:
        c = c.cast("string")
        quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.when(F.coalesce(c, F.lit("")) == "", "NULL").when(c.rlike(r"^-?\d+(\.\d+)?$"), c).otherwise(quoted)

    head = f"INSERT INTO {ident(name)} ({', '.join(map(ident, columns))}) VALUES ("
    return F.concat(F.lit(head), F.concat_ws(", ", *map(value, cells)), F.lit(");"))


def place_rows(df: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """df with place: the row's number, from 1, in that order, over the whole table but in no single task.

    The first order column is cut at ``parts`` values, which reach the driver; rows are numbered within
    each range, and the ranges before it add their counts. Rows that hold one value of it are one range.
    """
    first = F.col(order[0])
    cuts = [r[0] for r in df.where(first.isNotNull()).select(first.alias("k")).repartitionByRange(parts, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k")).orderBy("k").select("k").collect()]
    at = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= first)), F.lit(0)) if cuts else F.lit(0)
    ranged = df.withColumn("_range", F.when(first.isNull(), 0).otherwise(at))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    placed = numbered.join(F.broadcast(before), "_range")  # a row a range
    return placed.withColumn("place", (F.col("_before") + F.col("_at")).cast("int")).drop("_range", "_before", "_at")


def markdown(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """place, line: a table whose columns are as wide as their widest cell; the head has places 0 and 1."""
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    widths = df.agg(*(F.greatest(F.max(F.length(cells[c])), F.lit(max(3, len(c)))).alias(f"w_{c}") for c in columns))
    pad = lambda c, w: F.rpad(c, F.greatest(w, F.length(c)), F.lit(" "))
    row = lambda f: F.concat(F.lit("| "), F.concat_ws(" | ", *(f(c) for c in columns)), F.lit(" |"))
    head = widths.select(F.posexplode(F.array(row(lambda c: pad(F.lit(c), F.col(f"w_{c}"))), row(lambda c: F.repeat(F.lit("-"), F.col(f"w_{c}"))))).alias("place", "line"))
    placed = place_rows(df, order).withColumn("place", F.col("place") + 1)
    return head.union(placed.crossJoin(F.broadcast(widths)).select("place", row(lambda c: pad(cells[c], F.col(f"w_{c}"))).alias("line")))
