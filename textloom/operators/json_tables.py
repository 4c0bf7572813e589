"""JSON texts as tables and as types.

A text is walked once, by a small helper a row, into one array: the records of its table with their cells, its
merged shapes, or its nodes. Tables, headers, counts and types are expressions over that array, so a text's rows
meet without a shuffle; operators that take cells or shapes as rows group them by text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .jsons import _kind, _Number, _read

STEPS = "array<struct<name:string,index:int,nth:int>>"  # nth: the place among its parent's children
_STEPS = pa.list_(pa.struct([("name", pa.string()), ("index", pa.int32()), ("nth", pa.int32())]))


def number_text(written: str) -> str:
    """A number as a browser writes it: the shortest digits that read back the same, powers only below 1e-6 and from 1e21 on."""
    if len(written) < 16 and written.isdecimal() and (written[0] != "0" or written == "0"):
        return str(written)  # most are
    x = float(written)
    if x == 0 or x in (float("inf"), float("-inf")):
        return "0" if x == 0 else "null"
    sign = "-" * (x < 0)
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    at = len(whole) + int(exponent or 0)  # digits before the point
    digits = (whole + part).lstrip("0")
    at -= len(whole + part) - len(digits)
    digits = digits.rstrip("0") or "0"
    if 0 < at <= 21:
        out = digits.ljust(at, "0")[:at] + ("." + digits[at:] if len(digits) > at else "")
    elif -6 < at <= 0:
        out = "0." + "0" * -at + digits
    else:
        out = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if at > 0 else '-'}{abs(at - 1)}"
    return sign + out


def _compact(x: object) -> str:
    """As a browser writes JSON: no blanks, numbers in their shortest form."""
    if isinstance(x, _Number):
        return number_text(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_compact, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def _walk(value: object, texts: bool):
    stack: list[tuple] = [([], None, value)]
    pos = 0
    while stack:
        steps, up, x = stack.pop()
        kind = _kind(x)
        if kind in ("object", "array"):
            text = _compact(x) if texts else None
            children = [(steps + [{"name": k, "index": None, "nth": i}], pos, v) for i, (k, v) in enumerate(x.items())] if kind == "object" else [(steps + [{"name": None, "index": i, "nth": i}], pos, v) for i, v in enumerate(x)]
            stack += reversed(children)
            size = len(children)
        else:
            size, text = 0, None if x is None else str(x).lower() if kind == "boolean" else number_text(x) if kind == "number" else x
        yield pos, up, steps, kind, size, text
        pos += 1


def sorted_names(x: object) -> object:
    """Names in order at every level: letters before their accents, lower case first."""
    if isinstance(x, dict):
        return {k: sorted_names(x[k]) for k in sorted(x, key=lambda k: (unicodedata.normalize("NFKD", k).casefold(), k.swapcase()))}
    return [sorted_names(v) for v in x] if isinstance(x, list) else x


#: Nodes that are held at a time, whatever the number of texts in a batch (one text is held whole).
MOST_NODES = 4_000


def _walked(b: pa.RecordBatch, walk: Callable[[object], Iterable[tuple]]):
    """(places of the valid texts in the batch, what walk makes of each), some texts at a time."""
    at: list[int] = []
    found: list[list[tuple]] = []
    held = 0
    for i, t in enumerate(b.column("_json").to_pylist()):
        if t is None:
            continue
        try:
            value = _read(t)
        except (ValueError, RecursionError):
            continue
        at.append(i)
        found.append(list(walk(value)))
        held += max(len(found[-1]), 10)
        if held >= MOST_NODES:
            yield at, found
            at, found, held = [], [], 0
    if at:
        yield at, found


def _offsets(lengths: Iterable[int]) -> pa.Array:
    return pa.array(accumulate(lengths, initial=0), pa.int32())


def tree(df: DataFrame, key: str, text: str, texts: bool = False, sort: bool = False) -> DataFrame:
    """key, pos, up (the parent's pos), steps, type, size (children), value of each node, in the document's order, or by name.

    value is a leaf's text, and with texts a container's compact JSON. Null and invalid texts have no nodes.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, found in _walked(b, lambda value: _walk(sorted_names(value) if sort else value, texts)):
                flat = [n for nodes in found for n in nodes]
                lengths = [len(nodes) for nodes in found]
                steps = [x for n in flat for x in n[2]]
                names, indexes, nths = ([x[k] for x in steps] for k in ("name", "index", "nth"))
                inner = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(indexes, pa.int32()), pa.array(nths, pa.int32())], fields=list(_STEPS.value_type))
                taken = pa.array([i for i, n in zip(at, lengths, strict=True) for _ in range(n)], pa.int64())
                columns = [pa.array([n[k] for n in flat], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (3, pa.string()), (4, pa.int32()), (5, pa.string()))]
                columns.insert(2, pa.ListArray.from_arrays(_offsets(len(n[2]) for n in flat), inner, type=_STEPS))
                yield pa.RecordBatch.from_arrays([b.column("_key").take(taken), *columns], names=["_key", "pos", "up", "steps", "type", "size", "value"])

    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_json")).mapInArrow(run, f"_key {kind}, pos int, up int, steps {STEPS}, type string, size int, value string")
    return out.withColumnRenamed("_key", key)


@dataclass(frozen=True)
class TableOptions:
    arrays: str = "index"  # index: a column an element; join: one cell of the elements; json: one cell of JSON
    separator: str = "."
    join_with: str = ", "
    null_as: str = ""


def _records(value: object) -> tuple[str, bool, int, list]:
    """source, whether it is a list of records, pos of the list, the records of a text's table."""
    if isinstance(value, list):
        return "$", True, 0, value
    if isinstance(value, dict):
        pos = 1
        for name, x in value.items():
            if isinstance(x, list) and any(isinstance(v, dict) for v in x):
                return f"$.{name}", True, pos, x
            pos += _n_nodes(x)
    return "$", False, -1, [value]


def _n_nodes(value: object) -> int:
    stack, n = [value], 0
    while stack:
        x = stack.pop()
        n += 1
        stack += x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return n


def _leaf(x: object) -> str | None:
    if isinstance(x, _Number):
        return number_text(x)
    return str(x).lower() if isinstance(x, bool) else x


def _cells(value: object, o: TableOptions):
    """(source, record, pos, path, value, level) of each cell, in order; a list that is one cell is not walked into."""
    source, listed, pos, records = _records(value)
    pos += not listed
    empty = None if o.arrays == "json" else ""
    for record, top in enumerate(records):
        pos += listed
        stack = [("", top, 1, pos)]
        following = pos
        while stack:
            path, x, level, _ = stack.pop()
            at, following = following, following + 1
            if isinstance(x, (dict, list)):
                if not x:
                    said = empty if empty is not None else _compact(x)
                elif isinstance(x, list) and o.arrays != "index":
                    following += _n_nodes(x) - 1
                    if o.arrays == "json":
                        said = _compact(x)
                    else:
                        said = o.join_with.join(v for v in (o.null_as if v is None else _compact(v) if isinstance(v, (dict, list)) else _leaf(v) for v in x) if v is not None)
                elif isinstance(x, dict):
                    stack += reversed([(f"{path}{o.separator}{k}" if path else k, v, level + 1, 0) for k, v in x.items()])
                    continue
                else:
                    stack += reversed([(f"{path}[{i}]", v, level + 1, 0) for i, v in enumerate(x)])
                    continue
            else:
                said = o.null_as if x is None else _leaf(x)
                path = "value" if level == 1 else path
            yield source, record, at, path, said, level
        pos = following - 1


_CELL = pa.struct([("pos", pa.int32()), ("path", pa.string()), ("value", pa.string()), ("level", pa.int32())])
_TABLE = pa.list_(pa.struct([("record", pa.int32()), ("cells", pa.list_(_CELL))]))


def tables(df: DataFrame, key: str, text: str, options: TableOptions = TableOptions()) -> DataFrame:
    """key, source, records (record, cells of pos, path, value, level): the table that each valid text holds, in a row.

    The records are a root list's elements; else those of the root object's first list that has an object
    among its elements; else the root. A record that is neither list nor object has the column "value".
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, found in _walked(b, lambda value: _cells(value, options)):
                flat = [c for cells in found for c in cells]
                records = [[(r, len(list(own))) for r, own in groupby(cells, key=lambda c: c[1])] for cells in found]
                cells = pa.StructArray.from_arrays([pa.array([c[k] for c in flat], f.type) for k, f in zip((2, 3, 4, 5), _CELL, strict=True)], fields=list(_CELL))
                held = [r for own in records for r in own]
                lists = pa.ListArray.from_arrays(_offsets(n for _, n in held), cells, type=pa.list_(_CELL))
                rows = pa.StructArray.from_arrays([pa.array([r for r, _ in held], pa.int32()), lists], fields=list(_TABLE.value_type))
                whole = pa.ListArray.from_arrays(_offsets(map(len, records)), rows, type=_TABLE)
                source = pa.array([c[0][0] if c else None for c in found], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at, pa.int64())), source, whole], names=["_key", "source", "records"])

    shown = "array<struct<record:int,cells:array<struct<pos:int,path:string,value:string,level:int>>>>"
    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_json")).mapInArrow(run, f"_key {kind}, source string, records {shown}")
    return out.withColumnRenamed("_key", key).where("size(records) > 0")


def cells(df: DataFrame, key: str, text: str, options: TableOptions = TableOptions()) -> DataFrame:
    """key, record, pos, path, value, level, source: the cells of the table that each text holds, as tables() has them."""
    by_record = tables(df, key, text, options).select(key, "source", F.inline("records"))
    return by_record.select(key, "source", "record", F.inline("cells")).select(key, "record", "pos", "path", "value", "level", "source")


def _paths(cells: Column) -> Column:
    return F.transform(cells, lambda c: c["path"])


def headed(tables: DataFrame) -> DataFrame:
    """tables() with columns (in the order in which records first have them) and late (the first twenty that record 0 lacks)."""
    every = F.array_distinct(F.flatten(F.transform("records", lambda r: _paths(r["cells"]))))
    first = F.get("records", F.lit(0))
    lacks = F.when(first["record"] == 0, F.array_except("columns", _paths(first["cells"]))).otherwise(F.col("columns"))
    return tables.withColumn("columns", every).withColumn("late", F.slice(lacks, 1, 20))


def _filled(cells: Column, columns: Column) -> Column:
    """The record's cells under all columns, '' where it has none."""
    own = F.map_from_entries(F.transform(cells, lambda c: F.struct(c["path"], c["value"])))
    # most records have all columns in their order
    return F.when(_paths(cells) == columns, F.transform(cells, lambda c: F.coalesce(c["value"], F.lit("")))).otherwise(bound(own, lambda m: F.transform(columns, lambda c: F.coalesce(F.element_at(m, c), F.lit("")))))


def table_rows(tables: DataFrame, key: str) -> DataFrame:
    """key, record, columns, cells (of all columns, '' where the record has none), missing."""
    each = headed(tables).select(key, "columns", F.inline("records"))
    return each.select(key, "record", "columns", _filled(F.col("cells"), F.col("columns")).alias("cells"), (F.size("cells") < F.size("columns")).alias("missing"))


def table_summary(tables: DataFrame, key: str) -> DataFrame:
    """key, source, n_rows, n_columns, sparse_rows, late, depth of each text's table."""
    n = F.size("columns")
    sparse = F.size(F.filter("records", lambda r: F.size(r["cells"]) < n)).cast("long")
    depth = F.array_max(F.transform("records", lambda r: F.array_max(F.transform(r["cells"], lambda c: c["level"]))))
    return headed(tables).select(key, "source", F.size("records").cast("long").alias("n_rows"), n.alias("n_columns"), sparse.alias("sparse_rows"), "late", depth.alias("depth"))


def header(cells: DataFrame, key: str) -> DataFrame:
    """key, columns (in the order in which records first have them), late (the first twenty that the first record lacks)."""
    first = cells.groupBy(key, "path").agg(F.min(F.struct("record", "pos")).alias("first"))
    every = F.array_sort(F.collect_list(F.struct("first", "path")))
    late = F.slice(F.filter("_c", lambda c: c["first"]["record"] > 0), 1, 20)
    return first.groupBy(key).agg(every.alias("_c")).select(key, F.transform("_c", lambda c: c["path"]).alias("columns"), F.transform(late, lambda c: c["path"]).alias("late"))


def rows(cells: DataFrame, key: str) -> DataFrame:
    """key, record, cells (of all the text's columns, '' where the record has none), missing."""
    own = cells.groupBy(key, "record").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("_m"))
    both = own.join(header(cells, key), key)
    cell = F.transform("columns", lambda c: F.coalesce(F.element_at("_m", c), F.lit("")))
    return both.select(key, "record", cell.alias("cells"), (F.size("_m") < F.size("columns")).alias("missing"))


def summary(cells: DataFrame, key: str) -> DataFrame:
    """key, source, n_rows, n_columns, sparse_rows, late, depth of each text's table."""
    whole = cells.groupBy(key).agg(F.min("source").alias("source"), F.max("level").alias("depth"))
    counted = rows(cells, key).groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if("missing").alias("sparse_rows"))
    return whole.join(counted, key).join(header(cells, key), key).select(key, "source", "n_rows", F.size("columns").alias("n_columns"), "sparse_rows", "late", "depth")


def wide(cells: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """key, record and a column for each name, in the order in which it first comes, over all texts together.

    A table's columns are its schema, so their names come to the driver; more than ``most`` are an error.
    """
    first = cells.groupBy("path").agg(F.min(F.struct("record", "pos")).alias("first")).orderBy("first", "path").limit(most + 1)
    names = [r.path for r in first.collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    out = cells.groupBy(key, "record").pivot("path", names).agg(F.first("value"))
    return out.select(key, "record", *(F.coalesce(F.col(f"`{n.replace('`', '``')}`"), F.lit("")).alias(n) for n in names))


def stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_bytes, minified_bytes, depth, keys, arrays, objects, nulls, root of each valid text; the root's depth is 1."""
    kind = df.schema[key].dataType.simpleString()

    def counted(value: object):
        """The root's text, then depth, keys, lists, objects, nulls and the root's type."""
        depth, keys, n = 0, 0, dict.fromkeys(("array", "object", "null"), 0)
        stack = [(value, 1)]
        while stack:
            x, level = stack.pop()
            depth = max(depth, level)
            if isinstance(x, dict):
                n["object"] += 1
                keys += len(x)
                stack += [(v, level + 1) for v in x.values()]
            elif isinstance(x, list):
                n["array"] += 1
                stack += [(v, level + 1) for v in x]
            elif x is None:
                n["null"] += 1
        yield _compact(value) if isinstance(value, (dict, list)) else _leaf(value), depth, keys, *n.values(), _kind(value)

    def run(batches):
        for b in batches:
            for at, found in _walked(b, counted):
                kinds = (pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*(own[0] for own in found), strict=True), kinds, strict=True)]
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_key").take(taken), b.column("n_bytes").take(taken), *columns], names=["_key", "n_bytes", "value", "depth", "keys", "arrays", "objects", "nulls", "root"])

    n = df.select(F.col(key).alias("_key"), F.octet_length(text).alias("n_bytes"), F.col(text).alias("_json"))
    n = n.mapInArrow(run, f"_key {kind}, n_bytes int, value string, depth int, keys long, arrays long, objects long, nulls long, root string").withColumnRenamed("_key", key)
    root = F.col("root")
    small = F.when(root == "string", F.octet_length(F.to_json(F.struct("value"))) - 10).when(root == "null", 4).otherwise(F.octet_length("value"))
    return n.select(key, "n_bytes", small.alias("minified_bytes"), "depth", "keys", "arrays", "objects", "nulls", "root")


def _field(c: Column, delimiter: str, guarded: bool) -> Column:
    safe = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c) if guarded else c
    return bound(safe, lambda x: F.when(x.contains(delimiter) | x.rlike('["\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))


def _file(lines: Column, head: Column, with_header: bool, bom: bool, crlf: bool) -> Column:
    return F.concat(F.lit("\ufeff" if bom else ""), F.array_join(F.concat(F.array(head), lines) if with_header else lines, "\r\n" if crlf else "\n"))


def delimited_text(cells: DataFrame, key: str, *, delimiter: str = ",", with_header: bool = True, bom: bool = False, crlf: bool = False, guard: bool = True) -> DataFrame:
    """key, output: each text's table as a delimited file, its header first; cells (not the header) can be guarded against formulas.

    A table is one value here; write rows() where it is too large for that.
    """
    line = F.array_join(F.transform("cells", lambda c: _field(c, delimiter, guard)), delimiter)
    body = rows(cells, key).select(key, "record", line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("record", "line"))).alias("_l"))
    head = header(cells, key).select(key, F.array_join(F.transform("columns", lambda c: _field(c, delimiter, False)), delimiter).alias("_h"))
    return body.join(head, key).select(key, _file(F.transform("_l", lambda x: x["line"]), F.col("_h"), with_header, bom, crlf).alias("output"))


def table_files(tables: DataFrame, key: str, *, delimiter: str = ",", with_header: bool = True, bom: bool = False, crlf: bool = False, guard: bool = True) -> DataFrame:
    """key, output: what delimited_text() gives, of tables()."""
    line = lambda r: F.array_join(F.transform(_filled(r["cells"], F.col("columns")), lambda c: _field(c, delimiter, guard)), delimiter)
    head = F.array_join(F.transform("columns", lambda c: _field(c, delimiter, False)), delimiter)
    return headed(tables).select(key, _file(F.transform("records", line), head, with_header, bom, crlf).alias("output"))


# ---- types


def _shapes(value: object):
    """(steps, types with n and first, n, first, optional) of each place; a step is (name, False), or (None, True) for any element."""
    root: tuple = ((), {}, {}, None)  # steps, kinds, children, the kinds of the parent
    places, stack, pos = [root], [(root, value)], 0
    while stack:
        (steps, kinds, below, _), x = stack.pop()
        kind = _kind(x)
        if kind in kinds:
            kinds[kind][0] += 1
        else:
            kinds[kind] = [1, pos]
        pos += 1
        if kind == "object":
            inside = [((k, False), v) for k, v in x.items()]
        elif kind == "array":
            inside = [((None, True), v) for v in x]
        else:
            continue
        for step, v in reversed(inside):
            place = below.get(step)
            if place is None:
                place = below[step] = ((*steps, step), {}, {}, kinds)
                places.append(place)
            stack.append((place, v))
    for steps, kinds, _, up in places:
        n = sum(of[0] for of in kinds.values())
        lacks = up is not None and not steps[-1][1] and n < up["object"][0]
        yield steps, [(first, kind, times) for kind, (times, first) in kinds.items()], n, min(of[1] for of in kinds.values()), lacks


_SHAPE = pa.list_(pa.struct([("name", pa.string()), ("place", pa.bool_())]))
_TYPES = pa.list_(pa.struct([("first", pa.int32()), ("type", pa.string()), ("n", pa.int64())]))
_SHAPES = pa.list_(pa.struct([("shape", _SHAPE), ("types", _TYPES), ("n", pa.int64()), ("first", pa.int32()), ("optional", pa.bool_())]))


def merged_shapes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, shapes (shape, types, n, first, optional, as shapes() has them) of each valid text, in a row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, found in _walked(b, _shapes):
                flat = [s for own in found for s in own]
                steps, types = [x for s in flat for x in s[0]], [x for s in flat for x in s[1]]
                lists = [
                    pa.ListArray.from_arrays(_offsets(len(s[k]) for s in flat), pa.StructArray.from_arrays([pa.array([x[i] for x in items], f.type) for i, f in enumerate(t.value_type)], fields=list(t.value_type)), type=t)
                    for k, items, t in ((0, steps, _SHAPE), (1, types, _TYPES))
                ]
                plain = [pa.array([s[k] for s in flat], t) for k, t in ((2, pa.int64()), (3, pa.int32()), (4, pa.bool_()))]
                rows = pa.StructArray.from_arrays([*lists, *plain], fields=list(_SHAPES.value_type))
                yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(_offsets(map(len, found)), rows, type=_SHAPES)], names=["_key", "shapes"])

    shown = "array<struct<shape:array<struct<name:string,place:boolean>>,types:array<struct<first:int,type:string,n:bigint>>,n:bigint,first:int,optional:boolean>>"
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_json")).mapInArrow(run, f"_key {kind}, shapes {shown}").withColumnRenamed("_key", key)


def shapes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, shape (steps with null for any place of a list), types (first, type, n), n, first, optional: the merged nodes of each text.

    Objects in the same place merge, whatever stands between them, so that order is nothing. A property is
    optional if some object in its parent's place lacks it. A list without elements has no element's shape.
    """
    return merged_shapes(df, key, text).select(key, F.inline("shapes"))


def shape_rows(shapes: DataFrame, key: str) -> DataFrame:
    """key, path, types (joined by |, in the order in which they came), optional."""
    path = F.aggregate("shape", F.lit("$"), lambda a, s: F.when(s["place"], F.concat(a, F.lit("[]"))).otherwise(F.concat(a, F.lit("."), s["name"])))
    return shapes.select(key, path.alias("path"), F.array_join(F.transform("types", lambda t: t["type"]), "|").alias("types"), F.coalesce("optional", F.lit(False)).alias("optional"))


# Names that a type can't take.
RESERVED = ("Array", "Object", "String", "Number", "Boolean", "Date", "Function", "Error", "Map", "Set", "Promise", "Record", "Partial", "Required", "Readonly", "Symbol")


@dataclass(frozen=True)
class TypeOptions:
    root: str = "Root"
    style: str = "interface"  # or type
    optional: bool = True
    unknown: str = "unknown"  # or any
    readonly: bool = False
    nested: str = "named"  # or inline


@dataclass
class _Node:
    """A merged shape: what stands in one place of the documents."""

    kinds: tuple[str, ...]
    optional: bool
    members: dict[str, _Node]
    element: _Node | None = None

    def signature(self) -> str:
        """Equal for equal structures: each kind's, sorted."""
        parts = []
        for kind in self.kinds:
            if kind == "object":
                parts.append("{" + ",".join(sorted(f"{json.dumps(k)}{'?' * m.optional}:{m.signature()}" for k, m in self.members.items())) + "}")
            else:
                parts.append(f"[{self.element.signature() if self.element else ''}]" if kind == "array" else kind)
        return "|".join(sorted(parts))


def pascal(name: str) -> str:
    words = re.split(r"\s+|(?<=[a-z0-9])(?=[A-Z])", re.sub("[^A-Za-z0-9]+", " ", name).strip())
    joined = "".join(w[:1].upper() + w[1:] for w in words)
    return "Type" if not joined else joined if re.match("[A-Za-z_$]", joined) else f"Type{joined}"


def element_name(name: str) -> str:
    """What one element of a list of that name is called."""
    for pattern, cut, more in ((r"(?i)ies$", 3, "y"), (r"(?i)(?:s|x|z|ch|sh)es$", 2, ""), (r"(?i)[^su]s$", 1, "")):
        if re.search(pattern, name) and (cut != 3 or len(name) > 4):
            return name[:-cut] + more
    return f"{name}Item"


class _Declarations:
    """Writes one declaration for each structure; a name is taken when its structure is first met, from the root down."""

    def __init__(self, options: TypeOptions):
        self.o, self.blocks, self.names, self.taken = options, [], {}, set()
        self.counts = {"types": 0, "properties": 0, "optional": 0, "unions": 0}

    def unique(self, name: str) -> str:
        base = pascal(name)
        base += "Type" * (base in RESERVED)
        out, n = base, 2
        while out in self.taken:
            out, n = f"{base}{n}", n + 1
        self.taken.add(out)
        return out

    def type_of(self, node: _Node | None, name: str, level: int) -> str:
        if node is None:
            return self.o.unknown
        self.counts["unions"] += len(node.kinds) > 1
        said = []
        for kind in sorted(node.kinds, key=lambda k: k == "null"):
            if kind == "array":
                inner = self.type_of(node.element, element_name(name), level)
                said.append(f"({inner})[]" if node.element and len(node.element.kinds) > 1 else f"{inner}[]")
            else:
                said.append(self.object(node, name, level) if kind == "object" else kind)
        return " | ".join(said)

    def object(self, node: _Node, name: str, level: int) -> str:
        if self.o.nested == "inline":
            return self.body(node, level)
        key = _Node(("object",), False, node.members).signature()
        if key not in self.names:
            own = self.names[key] = self.unique(name)
            body = self.body(node, 0)
            self.counts["types"] += 1
            self.blocks.append(f"export interface {own} {body}" if self.o.style == "interface" else f"export type {own} = {body};")
        return self.names[key]

    def body(self, node: _Node, level: int) -> str:
        pad, end = "  " * (level + 1), "  " * level
        if not node.members:
            return f"{{\n{pad}[key: string]: {self.o.unknown};\n{end}}}" if self.o.style == "interface" else f"Record<string, {self.o.unknown}>"
        lines = []
        for k, m in node.members.items():
            lacks = self.o.optional and m.optional
            self.counts["properties"] += 1
            self.counts["optional"] += lacks
            label = k if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", k) else json.dumps(k, ensure_ascii=False)
            lines.append(f"{pad}{'readonly ' * self.o.readonly}{label}{'?' * lacks}: {self.type_of(m, k, level + 1)};")
        return "{\n" + "\n".join(lines) + f"\n{end}}}"

    def code(self, root: _Node) -> str:
        name = self.o.root.strip() or "Root"
        if root.kinds == ("object",) and self.o.nested != "inline":
            self.object(root, name, 0)
            self.blocks.insert(0, self.blocks.pop())  # the root first
        else:
            own = self.unique(name)
            said = self.type_of(root, name, 0)
            self.counts["types"] += 1
            self.blocks.append(f"export type {own} = {said};")
        return "\n\n".join(self.blocks) + "\n"


def _built(rows: list[dict]) -> _Node:
    """The tree of merged shapes, properties in the order in which they first came."""
    at: dict[tuple, _Node] = {}
    for r in sorted(rows, key=lambda r: (len(r["shape"]), r["first"])):
        steps = tuple((s["name"], s["place"]) for s in r["shape"])
        node = at[steps] = _Node(tuple(t["type"] for t in r["types"]), bool(r["optional"]), {})
        if steps and steps[-1][1]:
            at[steps[:-1]].element = node
        elif steps:
            at[steps[:-1]].members[steps[-1][0]] = node
    return at[()]


def declarations(shapes: DataFrame, key: str, options: TypeOptions = TypeOptions()) -> DataFrame:
    """key, code, types, properties, optional, unions: TypeScript declarations of each text's merged shapes.

    Objects of equal structure, wherever they stand, share one declaration; names come from properties,
    those of elements in the singular, and are made unique by a number. A text's declarations are one value,
    made from its merged shapes (not from its nodes) by a small writer.
    """
    each = shapes.groupBy(key).agg(F.collect_list(F.struct("shape", "types", "first", "optional")).alias("shapes"))
    return written_declarations(each, key, options)


def written_declarations(merged: DataFrame, key: str, options: TypeOptions = TypeOptions()) -> DataFrame:
    """What declarations() gives, of merged_shapes(). Texts of one shape are written once a batch."""
    kind = merged.schema[key].dataType.simpleString()
    slim = F.transform("shapes", lambda s: F.struct(s["shape"].alias("shape"), F.transform(s["types"], lambda t: F.struct(t["type"].alias("type"))).alias("types"), s["first"].alias("first"), s["optional"].alias("optional")))

    def run(batches):
        for b in batches:
            told = b.column("_shapes").dictionary_encode()
            out: list[tuple] = []
            for found in told.dictionary.to_pylist():
                d = _Declarations(options)
                out.append((d.code(_built(json.loads(found))), *d.counts.values()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            made = [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays([b.column("_key"), *(c.take(told.indices) for c in made)], names=["_key", "code", "types", "properties", "optional", "unions"])

    each = merged.select(F.col(key).alias("_key"), F.to_json(slim, {"ignoreNullFields": "false"}).alias("_shapes"))
    return each.mapInArrow(run, f"_key {kind}, code string, types int, properties int, optional int, unions int").withColumnRenamed("_key", key)
