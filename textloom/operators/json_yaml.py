"""JSON texts as YAML: each node's lines are an expression over the steps that lead to it, and a text is its nodes' lines in order."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json_tables import _kind, _leaf, _walked, sorted_names
from .jsons import yaml_ambiguous, yaml_needs_quotes


@dataclass(frozen=True)
class YamlOptions:
    indent: int = 2
    quote: str = "minimal"  # or single, double
    sort_keys: bool = False
    document_start: bool = False
    blocks: bool = True  # texts of several lines as literal blocks


CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
BROKEN = r"[\n\r\t\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"  # what single quotes can't hold


def double_quoted(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, said in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(said))
    code = lambda ch: F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(ch).cast("long"))), 2, "0"))
    coded = F.array_join(F.transform(F.split(out, ""), lambda ch: F.when(ch.rlike(CONTROL), code(ch)).otherwise(ch)), "")
    return F.concat(F.lit('"'), F.when(out.rlike(CONTROL), coded).otherwise(out), F.lit('"'))


def single_quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def _scalar(c: Column, quote: str) -> Column:
    """A text as a scalar of one line."""
    quoted = F.when(c.rlike(BROKEN), double_quoted(c)).otherwise(single_quoted(c))
    return {"double": double_quoted(c), "single": quoted, "minimal": F.when(yaml_needs_quotes(c), quoted).otherwise(c)}[quote]


def _label(c: Column, quote: str) -> Column:
    """A name; any colon in it asks for quotes."""
    return F.when(c.contains(":") & ~c.rlike(BROKEN), single_quoted(c)).otherwise(_scalar(c, quote)) if quote == "minimal" else _scalar(c, quote)


def _outline(value: object):
    """(pos, depth, name, dashes, type, size, value) of each node that writes something.

    dashes has a letter for each level that is indented: 1 where the node's line is the first of a list's element.
    """
    stack: list[tuple] = [(value, None, False, "", "")]
    pos = 0
    while stack:
        x, name, member, dashes, first = stack.pop()
        kind = _kind(x)
        children = list(x.items()) if kind == "object" else [(None, v) for v in x] if kind == "array" else []
        if member or not children:
            # a member stands at its object's level, so its own step indents nothing
            yield pos, len(dashes), name, dashes[:-1] if member else dashes, kind, len(children), None if isinstance(x, (dict, list)) else _leaf(x)
        listed = kind == "array"
        below = [(v, k, not listed, own, own if listed else "0" * len(own)) for i, (k, v) in enumerate(children) for own in ((first if i == 0 else "0" * len(first)) + "01"[listed],)]
        stack += reversed(below)
        pos += 1


_OUTLINE = (("pos", pa.int32(), "int"), ("depth", pa.int32(), "int"), ("name", pa.string(), "string"), ("dashes", pa.string(), "string"), ("type", pa.string(), "string"), ("size", pa.int32(), "int"), ("value", pa.string(), "string"))


def outline(df: DataFrame, key: str, text: str, sort: bool = False) -> DataFrame:
    """key and the columns of _outline() of each valid text's nodes, in the document's order, or by name."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, found in _walked(b, lambda value: _outline(sorted_names(value) if sort else value)):
                taken = pa.array([i for i, nodes in zip(at, found, strict=True) for _ in nodes], pa.int64())
                columns = [pa.array([n[k] for nodes in found for n in nodes], t) for k, (_, t, _) in enumerate(_OUTLINE)]
                yield pa.RecordBatch.from_arrays([b.column("_key").take(taken), *columns], names=["_key", *(n for n, _, _ in _OUTLINE)])

    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_json")).mapInArrow(run, f"_key {kind}, " + ", ".join(f"{n} {t}" for n, _, t in _OUTLINE))
    return out.withColumnRenamed("_key", key)


def yaml_lines(df: DataFrame, key: str, text: str, options: YamlOptions = YamlOptions()) -> DataFrame:
    """key, pos, lines, kind (structure, plain, quoted, ambiguous or block), value, depth of each node that writes something.

    A member of an object writes its label, a leaf its scalar; the first line that comes of a list's element
    has a dash in the place of the indent of that level.
    """
    n = outline(df, key, text, options.sort_keys)
    depth, value = F.col("depth"), F.col("value")
    is_text, leaf = F.col("type") == "string", ~F.col("type").isin("object", "array")

    pieces = F.split(value, "\n", -1)
    block = F.lit(options.quote == "minimal" and options.blocks) & is_text & value.contains("\n") & ~value.rlike(r"[\r\t]|" + CONTROL) & ~F.exists(pieces, lambda x: x.rlike("^ | $"))
    said = _scalar(value, options.quote)
    inline = F.when(is_text, said).when(F.col("type") == "null", "null").when(F.col("type") == "object", "{}").when(F.col("type") == "array", "[]").otherwise(value)
    ends = F.length(value) - F.length(F.regexp_replace(value, r"\n+$", ""))
    content = F.when(block, F.when(ends == 0, "|-").when(ends == 1, "|").otherwise("|+")).when(leaf | (F.col("size") == 0), inline)
    label = F.concat(_label(F.col("name"), options.quote), F.lit(":"))  # null where there is no name
    first = F.concat_ws(" ", label, content)

    pad, dash = " " * options.indent, "-".ljust(options.indent)

    indent = F.replace(F.replace("dashes", F.lit("0"), F.lit(pad)), F.lit("1"), F.lit(dash))
    begin = F.concat(indent, first)
    shown = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    body = F.transform(shown, lambda x: F.when(x == "", x).otherwise(F.concat(F.repeat(F.lit(pad), depth), x)))
    kind = F.when(block, "block").when(is_text & (said != value), F.when(yaml_ambiguous(value), "ambiguous").otherwise("quoted")).when(leaf, "plain").otherwise("structure")
    return n.select(key, "pos", F.when(block, F.concat(F.array(begin), body)).otherwise(F.array(begin)).alias("lines"), kind.alias("kind"), "value", F.greatest(depth, F.lit(1)).alias("depth"))


def to_yaml(df: DataFrame, key: str, text: str, options: YamlOptions = YamlOptions()) -> DataFrame:
    """key, output, n_lines, quoted, blocks, ambiguous (the first twelve), depth of each valid text in block style."""
    n = yaml_lines(df, key, text, options)
    in_order = F.array_sort(F.collect_list(F.struct("pos", "lines")))
    odd = F.array_sort(F.collect_list(F.when(F.col("kind") == "ambiguous", F.struct("pos", "value"))))
    out = n.groupBy(key).agg(
        F.flatten(F.transform(in_order, lambda x: x["lines"])).alias("_l"),
        F.count_if(F.col("kind").isin("quoted", "ambiguous")).alias("quoted"),
        F.count_if(F.col("kind") == "block").alias("blocks"),
        F.slice(F.array_distinct(F.transform(odd, lambda x: x["value"])), 1, 12).alias("ambiguous"),
        F.max("depth").alias("depth"),
    )
    lines = F.concat(F.array(F.lit("---")), "_l") if options.document_start else F.col("_l")
    return out.select(key, F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("output"), F.size(lines).alias("n_lines"), "quoted", "blocks", "ambiguous", "depth")
