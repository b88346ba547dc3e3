"""Tables written to the folder that the driver and all executors share, which cuts lineage for good."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset, and only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    path = f"{shared_root(df.sparkSession)}/graph-{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialize wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def if_small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """df marked for broadcast if its counted size allows, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Rows of names or paths that a join may hold in memory: a row of up to a kilobyte takes at most BROADCAST_BYTES then.
FEW = BROADCAST_BYTES >> 10


def if_few(df: DataFrame, rows: int) -> DataFrame:
    """df, of counted rows that hold paths or names, marked for broadcast if they are few, else kept from it."""
    return F.broadcast(df) if rows <= FEW else dealt(df)


def dealt(df: DataFrame) -> DataFrame:
    """df kept from being broadcast. Paths and names take little room in files, and by that the planner would send hundreds of
    thousands of them through the driver."""
    return df.hint("merge")


def is_light(df: DataFrame, text: str) -> bool:
    """Whether rows of little but a text, counted with its length, may be broadcast."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    return found["n"] * 64 + found["bytes"] <= BROADCAST_BYTES


#: Rows of a few numbers or short texts that one task sorts or gathers: about 100 MB.
TASK_ROWS = 1 << 19


def spread(df: DataFrame, rows: int, *by: str, most: int = TASK_ROWS) -> DataFrame:
    """df, of counted rows, dealt by columns so that a task gets about `most` of them; as it is, if every core has fewer anyway.
    Sizes in bytes, by which the planner makes tasks, say little about keys: 64 MB of a shuffle hold up to ten million."""
    parts = -(-rows // most)
    return df.repartition(parts, *by) if parts > df.sparkSession.sparkContext.defaultParallelism else df
