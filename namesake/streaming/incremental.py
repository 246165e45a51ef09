"""The update job: new article files bring new candidates, and their persons get new features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieve import retrieve
from ..params import Params
from ..schema import ARTICLE


def incremental_update(spark: SparkSession, in_dir: str, checkpoint: str, tables: Callable[[], dict[str, DataFrame]], apply: Callable[[DataFrame, DataFrame, int], None], cfg: Params | None = None) -> StreamingQuery:
    """Work through the Parquet files of articles that the checkpoint hasn't seen, then stop.

    tables() gives identity and link as they are now. For each batch apply(links, articles, batch) gets the new links and
    the new articles; it stores both and scores the persons of the links anew, whose counts and feedback depend on
    all their articles. Others keep their scores. A batch that is run again finds its links there already; records that
    were indexed late come as files like others.
    """

    def batch(articles: DataFrame, number: int) -> None:
        now = tables()
        apply(retrieve(now["identity"], articles, now["link"], cfg=cfg), articles, number)

    stream = spark.readStream.schema(ARTICLE).parquet(in_dir)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
