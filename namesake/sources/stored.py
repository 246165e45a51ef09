"""Tables kept in the warehouse by person (or another key): Spark's partitions, buckets and dynamic overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import fixed
from .tables import merge

PART = "part"


class Stored:
    """A table in parts by the key's hash, each part in buckets of the key, sorted.

    An upsert rewrites the parts that its keys are in, no others. Joins and groups by the key of tables with as many buckets
    need no shuffle. Writers of one table must take turns.
    """

    def __init__(self, spark: SparkSession, name: str, schema: str, key: str = "person_id", parts: int = 16, buckets: int | None = None):
        self.spark, self.name, self.key, self.parts = spark, name, key, parts
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            empty = spark.createDataFrame([], schema).withColumn(PART, F.lit(0))
            writer = empty.write.partitionBy(PART).bucketBy(self.buckets, key).sortBy(key)
            writer.option("partitionOverwriteMode", "dynamic").saveAsTable(name, format="parquet")

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(PART)

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their parts are read, if these are few."""
        wanted = keys.select(self.key).distinct()
        return self._in(self._touched(wanted)).drop(PART).join(wanted, self.key, "left_semi")

    def _part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._part()).distinct().collect()]  # parts at most

    def _in(self, parts: list[int]) -> DataFrame:
        return self.spark.table(self.name).filter(F.col(PART).isin(parts))

    def upsert(self, rows: DataFrame, keys: list[str], policy: str = "overwrite", order: str | None = None) -> None:
        """Put rows in as tables.merge() does."""
        rows = fixed(rows)
        parts = self._touched(rows)
        if parts:
            self._replace(merge(self._in(parts).drop(PART), rows, keys, policy, order), parts)

    def delete(self, keys: DataFrame) -> None:
        """Remove all rows of some keys."""
        wanted = fixed(keys.select(self.key).distinct())
        parts = self._touched(wanted)
        if parts:
            self._replace(self._in(parts).drop(PART).join(wanted, self.key, "left_anti"), parts)

    def _replace(self, rows: DataFrame, parts: list[int]) -> None:
        """Write the rows as the only ones of the parts. They are fixed first, as they come from the files that go."""
        columns = [c for c in self.spark.table(self.name).columns if c != PART]
        whole = fixed(rows.select(*columns, self._part().alias(PART)).repartition(self.buckets, self.key))
        left = {r[0] for r in whole.select(PART).distinct().collect()}
        whole.write.mode("overwrite").insertInto(self.name)
        for part in set(parts) - left:  # an overwrite leaves parts alone that get no row
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({PART} = {part})")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
