"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, as the operators' word rules ask for.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the cluster's checkpoint folder.

    Where none is named, a temporary folder does only if all work runs in the driver's own process;
    on a cluster each executor would write to its own disk, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, executors may go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = sc._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def packed(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and the others of docs in the struct _row, where their names can't clash."""
    rest = [c for c in docs.columns if c not in named]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(True).alias("none"))
    return docs.select(*(F.col(f"`{c}`") for c in named), row.alias("_row"))


def unpacked(df: DataFrame, docs: DataFrame, named: tuple[str, ...], *results: str) -> DataFrame:
    """The columns of docs, the named ones as they are now, then the results; a column of docs named like a result gives way."""
    taken = {r.lower() for r in results}
    own = [F.col(c) if c in named else F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in taken]
    return df.select(*own, *results)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many rows, texts of any length, in a batch between the JVM and Python; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """run, a function of batches, after which freed memory goes back to the system: the worker serves other stages next."""

    def and_release(batches):
        yield from run(batches)
        release()

    return and_release


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; stops counting soon after."""
    return df.limit(rows + 1).count() <= rows
