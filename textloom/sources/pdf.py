"""Text of PDF files: a small reader of page content a file, lines and paragraphs by window functions.

Read are classic and Flate-compressed content streams and their text operators, with one byte a
character; a file in another form gives an error row. Files over the size limit aren't opened.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT = 12 << 20
STREAM = re.compile(rb"obj\s*<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|\[(?:\\.|\((?:\\.|[^\\()])*\)|[^\]])*\]|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]+|[^\s/\[\]()<>]+", re.S)
INSIDE = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|-?\d*\.?\d+", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    plain = ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else NAMED.get(m[1], m[1]), token[1:-1])
    return plain.decode("cp1252", "replace")


def _runs(content: bytes):
    """(x, y, size, text) of the shown strings, in their order."""
    x = y = line_x = line_y = 0.0
    size, leading, held = 10.0, 0.0, []
    for token in TOKEN.findall(content):
        if token[:1] in b"([</" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            held.append(token)
            continue
        number = [float(t) for t in held if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
        if token == b"Tf" and number:
            size = abs(number[-1]) or size
        elif token == b"BT":
            x = y = line_x = line_y = 0.0
        elif token == b"TL" and number:
            leading = number[-1]
        elif token in (b"Td", b"TD") and len(number) > 1:
            line_x, line_y = line_x + number[-2], line_y + number[-1]
            leading = -number[-1] if token == b"TD" else leading
            x, y = line_x, line_y
        elif token == b"Tm" and len(number) > 5:
            line_x, line_y = number[-2], number[-1]
            x, y = line_x, line_y
        elif token in (b"T*", b"'", b'"'):
            line_y -= leading
            x, y = line_x, line_y
        if token in (b"Tj", b"'", b'"', b"TJ") and held:
            shown = "".join(_string(p) if p[:1] in b"(<" else " " if float(p) < -220 else "" for p in INSIDE.findall(held[-1])) if token == b"TJ" else _string(held[-1])
            if shown:
                yield x, y, size, shown
            x += 0.5 * size * len(shown)
        held = []


def _read(batches):
    for b in batches:
        rows = []
        for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            page, before = 0, len(rows)
            try:
                if not data.startswith(b"%PDF-"):
                    raise ValueError("no PDF header")
                for head, body in STREAM.findall(data):
                    if b"/FlateDecode" in head:
                        body = zlib.decompressobj().decompress(body)
                    elif b"/Filter" in head:
                        continue
                    if b"BT" in body and re.search(rb"T[jJ]", body):
                        page += 1
                        rows += [(path, page, k, *run, None) for k, run in enumerate(_runs(body))]
                if len(rows) == before:
                    raise ValueError("no text in a form that is read")
            except (ValueError, zlib.error) as e:
                del rows[before:]
                rows.append((path, None, None, None, None, None, None, str(e)))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "page", "run", "x", "y", "size", "text", "error"])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """path, page, run, x, y, size, text, error of the PDF files that path names; a page is a content stream."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= LIMIT).select("path", "content").mapInArrow(_read, "path string, page int, run int, x double, y double, size double, text string, error string")
    large = files.where(F.col("length") > LIMIT).select("path", *(F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("run", "int"), ("x", "double"), ("y", "double"), ("size", "double"), ("text", "string"))), F.lit("too large").alias("error"))
    return small.union(large)


def page_lines(runs: DataFrame) -> DataFrame:
    """path, page, line_no, y, size, line: runs of nearly one height make a line, a wide gap is a space."""
    order = Window.partitionBy("path", "page").orderBy(F.desc("y"), "x", "run")
    near = F.abs(F.lag("y").over(order) - F.col("y")) <= F.greatest(F.lit(2.0), F.least("size", F.lag("size").over(order)) / 2)
    marked = runs.where("text is not null").withColumn("fresh", (~F.coalesce(near, F.lit(False))).cast("int"))
    placed = marked.withColumn("line_no", F.sum("fresh").over(order))
    inside = Window.partitionBy("path", "page", "line_no").orderBy("x", "run")
    end = F.lag(F.col("x") + 0.5 * F.col("size") * F.length("text")).over(inside)
    spaced = placed.withColumn("piece", F.when(F.col("x") - end > 0.22 * F.col("size"), F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    grouped = spaced.groupBy("path", "page", "line_no").agg(F.max("y").alias("y"), F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("x", "run", "piece"))).alias("p"))
    return grouped.select("path", "page", "line_no", "y", "size", F.array_join(F.col("p.piece"), "").alias("line"))


def texts(lines: DataFrame) -> DataFrame:
    """path, text: lines in order, an empty line where a new page or a drop of over 1.7 sizes begins."""
    w = Window.partitionBy("path").orderBy("page", "line_no")
    jump = (F.lag("page").over(w) != F.col("page")) | (F.lag("y").over(w) - F.col("y") > 1.7 * F.greatest("size", F.lag("size").over(w)))
    parts = lines.withColumn("out", F.when(F.coalesce(jump, F.lit(False)), F.concat(F.lit("\n"), F.col("line"))).otherwise(F.col("line")))
    return parts.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", "line_no", "out"))).alias("p")).select("path", F.array_join(F.col("p.out"), "\n").alias("text"))
