"""JSON texts written anew, one row at a time: indented or minified. Numbers stay as they were written."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .json_tables import sorted_names
from .jsons import _never, _Number

def _dump(x: object, indent: str | None, sort: bool, level: int = 0) -> str:
    if isinstance(x, _Number):
        return str(x)
    if not isinstance(x, dict | list) or not x:
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, dict):
        colon = ": " if indent is not None else ":"
        parts = [json.dumps(k, ensure_ascii=False) + colon + _dump(v, indent, sort, level + 1) for k, v in (sorted_names(x) if sort else x).items()]
    else:
        parts = [_dump(v, indent, sort, level + 1) for v in x]
    a, z = "{}" if isinstance(x, dict) else "[]"
    if indent is None:
        return a + ",".join(parts) + z
    pad = "\n" + indent * (level + 1)
    return a + pad + ("," + pad).join(parts) + "\n" + indent * level + z


def _rewrite(df: DataFrame, key: str, text: str, write: Callable[[object], str]) -> DataFrame:
    """key, output, error of each row whose text isn't null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out: list[str | None] = []
            errors: list[str | None] = []
            for t in b.column("_json").to_pylist():
                try:
                    out.append(write(json.loads(t, parse_int=_Number, parse_float=_Number, parse_constant=_never)))
                    errors.append(None)
                except json.JSONDecodeError as e:
                    out.append(None)
                    errors.append(f"line {e.lineno}, column {e.colno}: {e.msg}")
                except (ValueError, RecursionError) as e:
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["_key", "output", "error"])

    slim = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_json"))
    return slim.mapInArrow(run, f"_key {kind}, output string, error string").withColumnRenamed("_key", key)


def beautify(df: DataFrame, key: str, text: str, indent: str = "  ", sort: bool = False) -> DataFrame:
    return _rewrite(df, key, text, lambda x: _dump(x, indent, sort))


def minify(df: DataFrame, key: str, text: str, sort: bool = False) -> DataFrame:
    return _rewrite(df, key, text, lambda x: _dump(x, None, sort))


# What common mistakes in JSON are answered with.
HINTS = {
    "quotes": "JSON strings must use double quotes. Single quotes are valid JavaScript but not valid JSON.",
    "comma": "There is probably a trailing comma before this bracket. JSON does not allow one.",
    "word": "Property names must be quoted, and the only bare words JSON allows are true, false and null.",
    "end": "The input stops early — a bracket or brace was opened and never closed.",
    "number": "NaN and Infinity are not valid JSON numbers. Use null or a string.",
}


def diagnose(df: DataFrame, key: str, text: str, most: int = 120) -> DataFrame:
    """key, line, column, excerpt, pointer, hint of each text that is not JSON; the first place that can't be read decides.

    The excerpt is that line, cut after so many characters; the pointer is a caret under the place. Only
    the place comes from a parser; the rest is expressions over it.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            at: list[int | None] = []
            for t in b.column("_json").to_pylist():
                try:
                    json.loads(t, parse_constant=_never)
                    at.append(None)
                except json.JSONDecodeError as e:
                    at.append(e.pos)
                except RecursionError:
                    at.append(0)
                except ValueError:  # a number that JSON doesn't have
                    at.append(min(x for x in (t.find(w) for w in ("NaN", "Infinity", "-Infinity")) if x >= 0))
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_json"), pa.array(at, pa.int32())], names=["_key", "_json", "_at"])

    slim = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_json"))
    bad = slim.mapInArrow(run, f"_key {kind}, _json string, _at int").where("_at is not null").withColumnRenamed("_key", key)
    # a comma before a bracket is told at the bracket
    ahead = F.substring("_json", F.col("_at") + 1, F.length("_json"))
    gap = F.when(ahead.rlike(r"^,\s*[}\]]"), F.length(F.regexp_extract(ahead, r"^(,\s*)", 1))).otherwise(0)
    bad = bad.withColumn("_at", F.col("_at") + gap)
    before, char = F.substring("_json", F.lit(1), F.col("_at")), F.substring("_json", F.col("_at") + 1, F.lit(1))
    own = F.substring_index(before, "\n", -1)
    line_text = F.concat(own, F.substring_index(F.substring("_json", F.col("_at") + 1, F.length("_json")), "\n", 1))
    near = F.substring("_json", F.greatest(F.col("_at") - 39, F.lit(1)), F.least(F.col("_at"), F.lit(40)))
    hint = (
        F.when((char == "'") | near.rlike(r"'\s*$"), HINTS["quotes"])
        .when(char.isin("}", "]"), HINTS["comma"])
        .when(near.rlike("NaN|Infinity") | F.substring("_json", F.col("_at") + 1, F.lit(9)).rlike("^-?(NaN|Infinity)"), HINTS["number"])
        .when(char.rlike("[a-zA-Z]"), HINTS["word"])
        .when(F.trim(F.substring("_json", F.col("_at") + 1, F.length("_json"))) == "", HINTS["end"])
    )
    column = F.length(own) + 1
    return bad.select(
        key,
        (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"),
        column.alias("column"),
        F.when(F.length(line_text) > most, F.concat(F.substring(line_text, 1, most), F.lit("…"))).otherwise(line_text).alias("excerpt"),
        F.concat(F.repeat(F.lit(" "), column - 1), F.lit("^")).alias("pointer"),
        hint.alias("hint"),
    )
