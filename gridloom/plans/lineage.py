"""Lineage cuts in the shared checkpoint folder, and order helpers that need them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; an own one only where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, by: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """df with a rank from 0 in the total order of `by`: range partitions are ranked in parallel and shifted by the counts before
    them. No single task sees all rows."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    # One row per partition: bounded by the number of partitions.
    return dealt.join(F.broadcast(before), "_part").withColumn(name, (nth - 1 + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_before")


#: Rows of one chunk of a prefix scan.
CHUNK = 100_000


def prefix_scan(df: DataFrame, position: str, value: str, out: str, group: list[str] | None = None, product: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Running sum (or product) of value along a dense position within each group, in two levels: within chunks of positions in
    parallel, then over the chunk totals."""
    group = group or []
    agg = F.product if product else F.sum
    chunked = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    w = Window.partitionBy(*group, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = chunked.withColumn("_in", agg(value).over(w))
    totals = chunked.groupBy(*group, "_chunk").agg(agg(value).alias("_total"))
    past = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_chunk", F.coalesce(agg("_total").over(past), F.lit(1.0 if product else 0.0)).alias("_off"))
    joined = inner.join(offsets, [*group, "_chunk"])
    return joined.withColumn(out, F.col("_in") * F.col("_off") if product else F.col("_in") + F.col("_off")).drop("_chunk", "_in", "_off")
