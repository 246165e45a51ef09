"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

SLICE_CHARS = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it a local master gets a temporary one;
    on a cluster there is none that all machines see, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, *parts: str) -> DataFrame:
    """Write the frame as a Parquet table in the shared folder and read it again: the lineage ends there. With columns in
    `parts` each of their values has a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a frame that materialize() gave, when nothing will read it any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        while "=" in folder.getName():  # of a part
            folder = folder.getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def in_lowest(h: Column, share: Column) -> Column:
    """Whether a 64-bit hash is in the lowest share (0 to 1) of all hashes."""
    return h.cast("double") / float(1 << 64) + 0.5 <= share


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, one row at least; bounds a task's memory."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text))
        start = total = 0
        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, columns=("doc_id", "text")) -> DataFrame:
    """Apply make()() to slices of the documents.

    make runs once in each task and returns a function from {column: list} to {column: list or array};
    null texts arrive as None. Only `columns` are read, so other columns of any name do no harm.
    """
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        work = make()
        for part in slices(batches):
            got = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return docs.select(*columns).mapInArrow(run, schema)


def salts_for(rows: int, per_group: int = 50_000) -> int:
    """How many salts keep the rows of one key and salt near per_group, if one key had them all."""
    return max(1, -(-rows // per_group))


def number_within(df: DataFrame, counts: DataFrame, group: str, salt: str, order: list[str], name: str) -> DataFrame:
    """Add a gapless number from 0 within each group, without bringing a group into one task.

    counts has a row (group, salt, n) for each part of a group. Parts are numbered one by one and moved up by the
    sizes of the parts before them; the sizes are as many as groups times salts.
    """
    before = Window.partitionBy(group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, salt, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(group, salt).orderBy(*order))
    ranked = df.withColumn("_rank", rank)
    return ranked.join(offsets, [group, salt]).withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_before", "_rank")
