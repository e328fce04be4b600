"""Cutting the lineage of iterative plans, in the shared folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local session (as in tests) gets one in its warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def session_dir(spark: SparkSession) -> str:
    """What this session writes there; ``release`` deletes it."""
    return f"{shared_dir(spark)}/quillgraph-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "hop") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    An iteration's plan stays one step long, lost executors take nothing with them, nothing is computed twice, and the
    next step knows the size of what it reads.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this session has written into the shared folder. For when every result that reads it has been saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_of(df: DataFrame) -> int:
    """The bytes that Catalyst estimates; for a written table those of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Files of a table that is sent to all executors have at most so many bytes.
MOST_BYTES = 32 << 20


def beside(df: DataFrame, most: int = 1 << 20, beyond: str = "shuffle_hash") -> DataFrame:
    """A written table for the small side of a join: sent to all executors up to ``most`` rows and MOST_BYTES, hashed (or as ``beyond`` says) beyond that."""
    return df.hint("broadcast" if size_of(df) <= MOST_BYTES and df.count() <= most else beyond)


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: both sides are sorted and merged, and neither goes through the driver.

    Without that, Catalyst sends a side of up to 10 MB to all executors by way of the driver. It takes the share of a
    compressed file for the size of a column, so millions of ids pass for a few MB and fill the driver's memory.
    """
    return df.hint("merge")


def numbered(df: DataFrame, *order: Column | str, after: int = 0, name: str = "number") -> tuple[DataFrame, int]:
    """``df`` with a column of consecutive numbers behind ``after`` in the given order, and how many rows there are.

    Sorted by range and numbered within tasks; the driver adds up one count for each task, so no task sees all rows.
    """
    low = (1 << 33) - 1  # the place in its task of a monotonically increasing id
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["_part"], after + total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(starts, "_part bigint, _first bigint")
    rows = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(first), "_part")  # a row for each task
    return rows.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit(low)) + 1).drop("_part", "_first", "_at"), total
