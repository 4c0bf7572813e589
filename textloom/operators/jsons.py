"""JSON texts as rows of (path, type, value), and what can be asked of such rows.

Leaves come from one small parser a row; everything else (stats, shapes, differences, tables) is
Spark aggregates and joins over them. Invalid texts have one row of type ``error``.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"^[A-Za-z_$][A-Za-z0-9_$]*$"


class _Number(str):
    """A number as it was written."""


_is_name = re.compile(NAME).match


def _child(path: str, name: str) -> str:
    return f"{path}.{name}" if _is_name(name) else f"{path}[{json.dumps(name, ensure_ascii=False)}]"


_KINDS = {_Number: "number", dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}


def _kind(x: object) -> str:
    return _KINDS[type(x)]


def _walk(value: object):
    """(path, shape, parent, type, depth, text of a leaf or of an empty container) of every node, in order; shape has [] for any index."""
    stack = [("$", "$", None, value, 1)]
    while stack:
        path, shape, parent, x, depth = stack.pop()
        kind = _kind(x)
        leaf = kind not in ("object", "array")
        text = (None if x is None else str(x).lower() if kind == "boolean" else str(x)) if leaf else None if x else "{}" if kind == "object" else "[]"
        yield path, shape, parent, kind, depth, text
        if kind == "object":
            stack += reversed([(_child(path, k), _child(shape, k), shape, v, depth + 1) for k, v in x.items()])
        elif kind == "array":
            stack += reversed([(f"{path}[{i}]", f"{shape}[]", shape, v, depth + 1) for i, v in enumerate(x)])


def _never(text: str):
    raise ValueError(f"{text} is not JSON")


#: Reads numbers as they were written.
_written = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_never).decode


def _read(text: str) -> object:
    if text.startswith("\ufeff"):
        raise ValueError("a byte order mark is not JSON")
    return _written(text)


def _nodes(batches):
    for b in batches:
        out: list[tuple] = []
        for i, text in enumerate(b.column("_json").to_pylist()):
            if text is None:
                continue
            try:
                value = _read(text)
                out += [(i, k, *row) for k, row in enumerate(_walk(value))]
            except (ValueError, RecursionError) as e:
                out.append((i, 0, "$", "$", None, "error", 0, str(e)))
        columns = list(zip(*out, strict=True)) or [()] * 8
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names=["_key", "pos", "path", "shape", "parent", "type", "depth", "value"])


def nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, path, shape, parent, type, depth, value of each node, in the document's order."""
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_json"))
    out = slim.mapInArrow(_nodes, f"_key {kind}, pos int, path string, shape string, parent string, type string, depth int, value string")
    return out.withColumnRenamed("_key", key)


def stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_bytes, depth, keys, arrays, objects, nulls, root."""
    n = nodes(df, key, text).where("type <> 'error'")
    has = lambda t: F.count_if(F.col("type") == t)
    named = F.count_if(~F.col("path").endswith("]") & (F.col("depth") > 1) | F.col("path").rlike(r'"\]$'))
    found = n.groupBy(key).agg(F.max("depth").alias("depth"), named.alias("keys"), has("array").alias("arrays"), has("object").alias("objects"), has("null").alias("nulls"), F.min_by("type", "pos").alias("root"))
    return df.select(key, F.octet_length(text).alias("n_bytes")).join(found, key)


def shape(df: DataFrame, key: str, text: str) -> DataFrame:
    """shape, types (sorted), n, optional: whether some parent object lacks it. Merging is an aggregate, so order is nothing."""
    n = nodes(df, key, text).where("type <> 'error'")
    kinds = n.groupBy("shape").agg(F.first("parent").alias("parent"), F.sort_array(F.collect_set("type")).alias("types"), F.count("*").alias("n"))
    objects = n.where("type = 'object'").groupBy(F.col("shape").alias("parent")).agg(F.count("*").alias("times"))
    in_array = F.col("shape").endswith("[]")
    return kinds.join(objects, "parent", "left").select("shape", "types", "n", F.coalesce(~in_array & (F.col("n") < F.col("times")), F.lit(False)).alias("optional"))


_SIDE = ("type", "value")
_PAIR = [f"{up}{x}_{side}" for up in ("", "up_") for side in "lr" for x in _SIDE]


def _by_path(text: str | None) -> dict[str, tuple]:
    """type, value (of a leaf or empty container) and the parent's path of each node by its path; nothing of what isn't JSON."""
    found: dict[str, tuple] = {}
    if text is None:
        return found
    try:
        stack: list[tuple] = [("$", None, _read(text))]
    except (ValueError, RecursionError):
        return found
    while stack:
        path, up, x = stack.pop()
        kind = _kind(x)
        if kind == "object":
            found[path] = kind, None if x else "{}", up
            stack += reversed([(_child(path, k), path, v) for k, v in x.items()])
        elif kind == "array":
            found[path] = kind, None if x else "[]", up
            stack += reversed([(f"{path}[{i}]", path, v) for i, v in enumerate(x)])
        else:
            found[path] = kind, None if x is None else str(x).lower() if kind == "boolean" else str(x), up
    return found


def _paired(batches):
    none = (None, None, None)
    for b in batches:
        texts = zip(b.column("_l").to_pylist(), b.column("_r").to_pylist(), strict=True)
        at: list[int] = []
        out: list[tuple] = []
        for i, (one, other) in enumerate(texts):
            left, right = _by_path(one), _by_path(other)
            for path in left | right:
                a, z = left.get(path, none), right.get(path, none)
                up = a[2] or z[2]
                at.append(i)
                out.append((path, up, *a[:2], *z[:2], *left.get(up, none)[:2], *right.get(up, none)[:2]))
            if len(out) >= 4000 or i + 1 == b.num_rows:
                columns = list(zip(*out, strict=True)) or [()] * 10
                yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=["_key", "path", "up", *_PAIR])
                at, out = [], []


def _pairs(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, up (the parent's path), type and value on both sides, of the node and of its parent: texts meet by their key, nodes within them."""
    kind = left.schema[key].dataType.simpleString()
    both = left.select(F.col(key).alias("_key"), F.col(text).alias("_l")).join(right.select(F.col(key).alias("_key"), F.col(text).alias("_r")), "_key", "full_outer")
    return both.mapInArrow(_paired, f"_key {kind}, path string, up string, {', '.join(f'{c} string' for c in _PAIR)}").withColumnRenamed("_key", key)


def diff(left: DataFrame, right: DataFrame, key: str, text: str, *, loose: bool = False, ignore_case: bool = False, types: bool = False) -> DataFrame:
    """key, path, kind (added, removed, changed, type), left, right: nodes of both sides by their path; with types also left_type, right_type.

    What lies under a node that was added, removed or changed its type is told by that node alone.
    """

    n = _told(_pairs(left, right, key, text), loose, ignore_case).where("kind is not null")
    shown = [F.coalesce(f"value_{side}", f"type_{side}").alias(name) for side, name in (("l", "left"), ("r", "right"))]
    return n.select(key, "path", "kind", *shown, *((F.col("type_l").alias("left_type"), F.col("type_r").alias("right_type")) if types else ()))


def _told(pairs: DataFrame, loose: bool, ignore_case: bool) -> DataFrame:
    """pairs with kind: how the node differs, null where it doesn't or where a node above it tells."""

    def told(up: str) -> Column:
        t_l, t_r = F.col(f"{up}type_l"), F.col(f"{up}type_r")
        v_l, v_r = F.coalesce(f"{up}value_l", t_l), F.coalesce(f"{up}value_r", t_r)
        same = F.lower(v_l).eqNullSafe(F.lower(v_r)) if ignore_case else v_l.eqNullSafe(v_r)
        leaf = ~t_l.isin("object", "array")
        differs = t_l != t_r
        if loose:
            differs = differs & ~(same & leaf & ~t_r.isin("object", "array"))
        return F.when(t_l.isNull(), "added").when(t_r.isNull(), "removed").when(differs, "type").when(leaf & ~same, "changed")

    breaks = F.col("up").isNotNull() & F.coalesce(told("up_").isin("added", "removed", "type"), F.lit(False))
    return pairs.withColumn("kind", F.when(~breaks, told("")))


def diff_unordered(left: DataFrame, right: DataFrame, key: str, text: str, *, loose: bool = False, ignore_case: bool = False) -> DataFrame:
    """key, path, kind, left, right, lists being bags: what only one side's list holds is removed or added, at path[].

    Elements are told apart by their canonical form, counted, and compared by a full outer join; what lies
    outside lists is compared as diff() does.
    """

    def bags(df: DataFrame, name: str) -> DataFrame:
        tops = nodes(df, key, text).where("type = 'array' and not contains(shape, '[]')").select(key, "path")
        kind = df.schema[key].dataType.simpleString()

        def run(batches):
            for b in batches:
                who, paths, items = [], [], []
                for i, t in enumerate(b.column("_json").to_pylist()):
                    try:
                        found = list(_bags(json.loads(t, parse_constant=_never))) if t is not None else []
                    except (ValueError, RecursionError):
                        found = []
                    for path, item in found:
                        who.append(i)
                        paths.append(path)
                        items.append(_plain(item, True, loose, ignore_case))
                yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(who, pa.int64())), pa.array(paths, pa.string()), pa.array(items, pa.string())], names=["_key", "path", "item"])

        rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_json")).mapInArrow(run, f"_key {kind}, path string, item string").withColumnRenamed("_key", key)
        held = tops.groupBy(key, "path").agg(F.lit(True).alias(f"has_{name}"))
        return rows.groupBy(key, "path", "item").agg(F.count("*").alias(f"n_{name}")), held

    (a, has_a), (b, has_b) = bags(left, "l"), bags(right, "r")
    both = a.join(b, [key, "path", "item"], "full_outer").fillna(0, ["n_l", "n_r"]).where("n_l <> n_r")
    both = both.join(has_a, [key, "path"], "left_semi").join(has_b, [key, "path"], "left_semi")  # lists on both sides
    more = F.col("n_l") > F.col("n_r")
    times = F.explode(F.array_repeat(F.lit(0), F.abs(F.col("n_l") - F.col("n_r")).cast("int")))
    listed = both.select(key, F.concat("path", F.lit("[]")).alias("path"), F.when(more, "removed").otherwise("added").alias("kind"), F.when(more, clip(F.col("item"))).alias("left"), F.when(~more, clip(F.col("item"))).alias("right"), times.alias("_")).drop("_")
    plain = diff(left, right, key, text, loose=loose, ignore_case=ignore_case)
    return plain.where(~F.col("path").rlike(r"\[\d+\]")).union(listed)


def _bags(value: object):
    """(path, element) of the outermost lists."""
    stack = [("$", value)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, list):
            for item in x:
                yield path, item
        elif isinstance(x, dict):
            stack += [(_child(path, k), v) for k, v in x.items()]


def diff_stats(changes: DataFrame, left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, added, removed, changed, type_changed, unchanged (leaves alike on both sides), identical."""
    same = _pairs(left, right, key, text).where(_alike()).groupBy(key).agg(F.count("*").alias("unchanged"))
    kinds = changes.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(name) for k, name in _COUNTED))
    out = left.select(key).join(right.select(key), key).join(kinds, key, "left").join(same, key, "left").fillna(0, ["added", "removed", "changed", "type_changed", "unchanged"])
    return out.withColumn("identical", F.col("added") + F.col("removed") + F.col("changed") + F.col("type_changed") == 0)


_COUNTED = (("added", "added"), ("removed", "removed"), ("changed", "changed"), ("type", "type_changed"))


def _alike() -> Column:
    """Whether a leaf is the same on both sides."""
    return F.col("type_l").eqNullSafe(F.col("type_r")) & F.col("value_l").eqNullSafe(F.col("value_r")) & ~F.col("type_l").isin("object", "array")


def diff_counts(left: DataFrame, right: DataFrame, key: str, text: str, *, loose: bool = False, ignore_case: bool = False) -> DataFrame:
    """What diff_stats() gives of diff(), in one aggregate: each text is read once."""
    n = _told(_pairs(left, right, key, text), loose, ignore_case)
    found = n.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(name) for k, name in _COUNTED), F.count_if(_alike()).alias("unchanged"))
    out = left.select(key).join(right.select(key), key).join(found, key, "left").fillna(0, [*(name for _, name in _COUNTED), "unchanged"])
    return out.withColumn("identical", F.col("added") + F.col("removed") + F.col("changed") + F.col("type_changed") == 0)


def change_line(kind: Column, path: Column, left: Column, right: Column, left_type: Column, right_type: Column) -> Column:
    """A change as one line for a review."""
    arrow = F.concat(left, F.lit(" → "), right)
    typed = F.concat(left, F.lit(" ("), left_type, F.lit(") → "), right, F.lit(" ("), right_type, F.lit(")"))
    say = lambda mark, what: F.concat(F.lit(f"{mark} "), path, F.lit(": "), what)
    return F.when(kind == "added", say("+", right)).when(kind == "removed", say("−", left)).when(kind == "type", say("!", typed)).otherwise(say("~", arrow))


def clip(c: Column, most: int = 90) -> Column:
    """A value of at most so many characters; null is a dash."""
    return F.when(c.isNull(), "—").when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def _plain(x: object, sort_arrays: bool, loose: bool, ignore_case: bool) -> str:
    again = lambda v: _plain(v, sort_arrays, loose, ignore_case)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{again(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        parts = [again(v) for v in x]
        return f"[{','.join(sorted(parts) if sort_arrays else parts)}]"
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
        x = int(x)
    if loose and isinstance(x, (bool, int, float)):
        return json.dumps(json.dumps(x))
    return json.dumps(x.lower() if ignore_case and isinstance(x, str) else x, ensure_ascii=False)


def canonical(df: DataFrame, key: str, text: str, *, sort_arrays: bool = False, loose: bool = False, ignore_case: bool = False) -> DataFrame:
    """key, canonical: a form in which equal values are equal texts: sorted keys, no blanks; null if it isn't JSON.

    A value's depth is its own, so the form is made by a small parser a row, in Arrow batches.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out: list[str | None] = []
            for t in b.column("_json").to_pylist():
                try:
                    out.append(None if t is None else _plain(json.loads(t, parse_constant=_never), sort_arrays, loose, ignore_case))
                except (ValueError, RecursionError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(out, pa.string())], names=["_key", "canonical"])

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_json")).mapInArrow(run, f"_key {kind}, canonical string").withColumnRenamed("_key", key)


def yaml_ambiguous(c: Column) -> Column:
    """Whether a bare scalar would be read as something other than a text."""
    return c.rlike(r"^(?i:true|false|yes|no|on|off|y|n|null|~|[-+]?\.inf|\.nan)$") | c.rlike(r"^[-+]?(\d[\d_]*)?\.?\d+([eE][-+]?\d+)?$") | c.rlike(r"^0[xo][0-9a-fA-F]+$") | c.rlike(r"^\d+(:\d{1,2})+(\.\d*)?$") | c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}")


def yaml_needs_quotes(c: Column) -> Column:
    """Whether a bare scalar would be read as something else, or break the line."""
    unsafe = (c == "") | c.rlike(r"^\s|\s$") | c.rlike(r"^[!&*|>'\"%@`#{}\[\],]") | c.rlike(r"^[-?:](\s|$)") | c.contains(": ") | c.endswith(":") | c.rlike(r"\s#") | c.rlike(r"[\x00-\x1F\x7F]")
    return yaml_ambiguous(c) | unsafe
