"""Running sums and order statistics over tables of any size: sorted ranges, their totals, and offsets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting by which a finished query's shuffle files are removed.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, a folder that all machines must share; where it isn't set, a local master gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
    return context.getCheckpointDir()


def fixed(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the checkpoint folder: what reads it twice reads the same rows in the same parts."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept as Parquet in the checkpoint folder: what reads it takes only the columns it needs.
    What was shuffled for it goes from the disk when it is written, not when the session ends."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_ranges(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """The rows in ranges of the keys, each range sorted, with its number in _part: ranges ascend as the keys do. The ranges are
    about equally large, wherever the keys pile up, as long as no key has very many rows: group them first."""
    return fixed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, key: Column, sums: list[str], group: list[str] | None = None) -> DataFrame:
    """Add to rows, one for each different key of a group, the sums of all rows up to the key (s_upto) and of all (s_all).

    Sums are taken inside the ranges; the ranges' totals, a row for each range and group, are added on. No window holds
    more than a range, or the totals.
    """
    group = group or []
    parts = sorted_ranges(rows, *group, key)
    totals = parts.groupBy(*group, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(*group, "_part", *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_before") for s in sums], *[F.sum(f"_{s}").over(whole).alias(f"{s}_all") for s in sums])
    inside = Window.partitionBy(*group, "_part").orderBy(key)
    placed = parts.join(offsets, [*group, "_part"])
    out = placed.withColumns({f"{s}_upto": F.col(f"_{s}_before") + F.sum(s).over(inside) for s in sums})
    return out.drop("_part", *[f"_{s}_before" for s in sums])


def quantile(rows: DataFrame, value: str, share: float, group: list[str] | None = None) -> DataFrame:
    """(*group, value) at the share of each group's rows, exactly: between two values, their mean weighted by nearness."""
    group = group or []
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    at = F.lit(share) * (F.col("n_all") - 1)  # from 0
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
    low, high = F.floor(at), F.ceil(at)
    near = running(counted, F.col(value), ["n"], group).filter((first <= high) & (last >= low))
    hit = lambda place: F.max(F.when((first <= place) & (place <= last), F.col(value)))
    ends = near.groupBy(*group).agg(hit(low).alias("_low"), hit(high).alias("_high"), F.max(at - low).alias("_off"))
    return ends.select(*group, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_off")).alias(value))


def lowest(rows: DataFrame, value: str, share: float, group: list[str]) -> DataFrame:
    """(*group, value): the value up to which just the share of each group's rows lies (rounded), where values differ."""
    counted = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    within = running(counted, F.col(value), ["n"], group).filter(F.col("n_upto") <= F.round(F.col("n_all") * share))
    return within.groupBy(*group).agg(F.max(value).alias(value))
