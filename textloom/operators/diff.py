"""Line differences that keep the order of both sides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 4_000_000  # of a table; larger ones are told as removed, then added


def _align(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """(same, removed or added, place in a, place in b), a removal before an addition on ties; -1: no place."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [("same", i, i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y or len(x) * len(y) > CELLS:
        out += [("removed", head + i, -1) for i in range(len(x))] + [("added", -1, head + j) for j in range(len(y))]
    else:
        names: dict[str, int] = {}
        u, v = (np.array([names.setdefault(s, len(names)) for s in side]) for side in (x, y))
        common = np.zeros((len(u) + 1, len(v) + 1), np.int32)  # longest common part of what is left
        for i in range(len(u) - 1, -1, -1):
            row = np.maximum(common[i + 1, :-1], np.where(v == u[i], common[i + 1, 1:] + 1, 0))
            common[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
        i = j = 0
        while i < len(u) or j < len(v):
            if i < len(u) and j < len(v) and u[i] == v[j]:
                out.append(("same", head + i, head + j))
                i, j = i + 1, j + 1
            elif j == len(v) or (i < len(u) and common[i + 1, j] >= common[i, j + 1]):
                out.append(("removed", head + i, -1))
                i += 1
            else:
                out.append(("added", -1, head + j))
                j += 1
    return out + [("same", len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def line_diff(df: DataFrame, key: str, left: str, right: str, *, ignore_whitespace: bool = False, ignore_case: bool = False) -> DataFrame:
    """key, pos, kind, left_no, right_no, line (as it is on its own side) of each line of each pair of texts."""
    kind = df.schema[key].dataType.simpleString()

    def fold(s: str) -> str:
        s = " ".join(s.split()) if ignore_whitespace else s
        return s.lower() if ignore_case else s

    def run(batches):
        for batch in batches:
            who, rows = [], []
            for i, (l, r) in enumerate(zip(batch.column("l").to_pylist(), batch.column("r").to_pylist(), strict=True)):
                a, b = ((t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n") for t in (l, r))
                for k, (what, x, y) in enumerate(_align(list(map(fold, a)), list(map(fold, b)))):
                    who.append(i)
                    rows.append((k, what, x if x >= 0 else None, y if y >= 0 else None, a[x] if x >= 0 else b[y]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(who, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["k", "pos", "kind", "left_no", "right_no", "line"])

    slim = df.select(F.col(key).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    return slim.mapInArrow(run, f"k {kind}, pos int, kind string, left_no int, right_no int, line string").withColumnRenamed("k", key)


def diff_stats(diff: DataFrame, key: str) -> DataFrame:
    return diff.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "same")))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of each side that the other has fewer times, with kind."""
    return left.exceptAll(right).withColumn("kind", F.lit("removed")).union(right.exceptAll(left).withColumn("kind", F.lit("added")))
