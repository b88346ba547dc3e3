"""Shared plumbing of the llm operators: the scratch folder that all executors see, and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache as once

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its counted rows times its row width stay below this; beyond it the join shuffles.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 48
#: The setting of a batch's bytes, and its value here.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: ASCII white space, the separators of words in every operator here.
BLANKS = "[\\x20\\x09-\\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a folder of our own in local mode and an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


class Scratch:
    """Tables written once to the shared folder and read back, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables whose readers have all finished."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget_finished(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps, which otherwise stay until the driver's heap fills.
    A plan is collected a round after what refers to it, and the cleaner works beside the driver."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its counted size is within the limit, else as it is (a shuffled join). A row takes
    ROW_BYTES in a hash table besides its own."""
    return F.broadcast(df) if rows * (row_bytes + ROW_BYTES) <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores after them as make them no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, keys: list[Column], gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """df less the rows whose keys, nulls included, are a row of gone, a written table; or, with left_semi, only them."""
    names = fresh(df, *(f"gone_{i}" for i in range(len(keys))))
    match = None
    for key, name in zip(keys, names, strict=True):
        same = key.eqNullSafe(F.col(name))
        match = same if match is None else match & same
    return df.join(if_small(gone.toDF(*names), gone.count(), 24 * len(keys) + 32), match, how)


def text_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


@once
def system_library() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def settle() -> None:
    """Gives freed memory back to the system: workers are reused, and what their allocators hold on to counts against the
    executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(system_library(), "malloc_trim", None)
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the batches that Python workers get, unless the session's user has. By Spark's default of 64 MB
    each task can hold several times that, in the JVM and again in Python."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, BATCH_BYTES)


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """mapInArrow whose function yields columns as a dict of lists or arrays, in the order and types of the DDL schema."""
    into = arrow_schema(schema)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip((columns[f.name] for f in into), into, strict=True)], schema=into)
        settle()

    return df.mapInArrow(run, schema)


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def binary_slices(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column, one at a time; null counts as empty."""
    for x in column:
        yield x.as_py() or b""
