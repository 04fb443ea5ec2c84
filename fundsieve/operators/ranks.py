"""Tables written to the shared folder, columns computed once, and exact ranks without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a monotonically increasing id that count within its partition.
WITHIN = 33
#: Rows of a table that one task takes where each row is dear.
DEALT = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset a temporary folder takes its place, in local mode only: on a cluster other machines would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """A table's rows dealt out by keys to as many tasks as its rows ask for.

    A row group of a file is read by one task, and a million short rows may be one: what is made of them would be made
    and sorted there as well. Rows of a table as it is read are counted from its footers.
    """
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // DEALT))
    return table.repartition(tasks, *keys)


def settled(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that are computed once a row, one after the other.

    The optimizer moves filters below projections and joins projections into one, and copies what they use; inside a
    lambda such a copy would run once an element. It does not look through a generator, so each value comes out of one
    that makes one row of each row.
    """
    for name, value in values.items():
        df = df.select(*[F.col(c) for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))
    return df


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its place from 1 by an order without ties.

    Rows are dealt out by ranges of the order and sorted where they lie; the table is written, so that places stay when
    an executor is lost. The rows before each range are a sum over the ranges, of which there are as many as
    partitions, and go to all tasks.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = durable(dealt, "ranked").withColumn("_range", F.shiftright("_at", WITHIN))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND((1 << WITHIN) - 1)
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + within + 1).drop("_range", "_at", "_before")
