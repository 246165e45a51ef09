"""The whole update by kept state: new articles and decisions move counts, and only the persons they concern are scored anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import feedback, model
from ..operators.candidates import candidates
from ..operators.order import fixed
from ..operators.retrieve import retrieve
from ..operators.target import resolve_target_author, with_target
from ..params import Params
from ..schema import ARTICLE
from ..sources.stored import Stored

LINK = "person_id string, pmid long, source string, target_author_index int, batch long"
CURATION = "person_id string, pmid long, assertion string, batch long"
VALUES = "person_id string, dim string, value string, accepted long, rejected long, batch long"
TOTALS = "person_id string, total_accepted long, total_rejected long, batch long"
SCORE = "person_id string, pmid long, model_type string, raw_score double, calibrated_score double, batch long"
KEYS = ["person_id", "pmid"]


class Updates:
    """Tables of links, decisions, scores and state under a common prefix, and the job that brings them up to date.

    The state has, of each person, dimension and value, how many accepted and rejected candidates have the value, and of
    each person how many candidates are accepted and rejected: what feedback needs of all other articles. A batch adds
    its own part to the counts.

    Every row has the number of the batch that wrote it last. A batch looks at links and decisions of earlier batches only
    and leaves alone counts that have its number or a later one, so that a batch that broke off anywhere, or comes
    again, ends in the same tables.
    """

    def __init__(self, spark: SparkSession, prefix: str, identity: DataFrame, score: Callable[[DataFrame], DataFrame], cfg: Params | None = None, parts: int = 16, article_schema: str = ARTICLE):
        """score: takes model.features() and gives person_id, pmid, model_type, raw_score, calibrated_score."""
        self.spark, self.identity, self.score, self.cfg = spark, identity, score, cfg
        table = lambda name, schema, key="person_id": Stored(spark, f"{prefix}_{name}", schema, key, parts)
        self.article = table("article", article_schema, "pmid")
        self.link, self.curation, self.scores = table("link", LINK), table("curation", CURATION), table("score", SCORE)
        self.values, self.totals = table("values", VALUES), table("totals", TOTALS)

    def apply(self, articles: DataFrame, decisions: DataFrame, batch: int) -> None:
        """Put in a batch's articles and decisions (person_id, pmid, assertion). Stored articles and decisions stay as they are.

        In order: articles, links, decisions, then the state, then scores: each step can be done again.
        """
        # Both tables are stored at the end of the batch's own part only, so what earlier batches left is at hand in a repeat.
        before = F.col("batch") < batch
        number = F.lit(batch).cast("long").alias("batch")
        self.article.upsert(articles, ["pmid"], "keep")
        links, marks = self.link.read().filter(before), self.curation.read().filter(before)
        found = retrieve(self.identity, articles, links.select(*KEYS), cfg=self.cfg)
        named = found.join(self.identity, "person_id").join(articles.drop("source"), "pmid")
        new_links = fixed(resolve_target_author(named).select(*KEYS, "source", "target_author_index", number))
        first = decisions.groupBy(*KEYS).agg(F.min("assertion").alias("assertion"))  # an accepted one, if a batch has both
        new_marks = fixed(first.filter(F.col("assertion").isin("ACCEPTED", "REJECTED")).join(marks, KEYS, "left_anti").select(*KEYS, "assertion", number))

        # Decided candidates that weren't both linked and decided before add to the counts.
        fresh_links = new_links.join(marks.select(*KEYS, "assertion").unionByName(new_marks.select(*KEYS, "assertion")), KEYS)
        fresh_marks = links.select(*KEYS, "target_author_index").join(new_marks, KEYS)
        columns = [*KEYS, "target_author_index", "assertion"]
        fresh = fixed(fresh_links.select(columns).unionByName(fresh_marks.select(columns)))

        self.link.upsert(new_links, KEYS, "keep")
        self.curation.upsert(new_marks, KEYS, "keep")
        rows = with_target(fresh.join(self.identity, "person_id").join(self.article.of(fresh).drop("source"), "pmid"))
        self._move(self.values, feedback.evidence(rows), ["person_id", "dim", "value"], ["accepted", "rejected"], batch)
        self._move(self.totals, fresh, ["person_id"], ["total_accepted", "total_rejected"], batch)

        touched = fixed(new_links.select("person_id").unionByName(new_marks.select("person_id")).distinct())
        self.scores.upsert(self.score(self.features(touched)).select(*KEYS, "model_type", "raw_score", "calibrated_score", number), [*KEYS, "model_type"])

    def _move(self, table: Stored, rows: DataFrame, keys: list[str], counts: list[str], batch: int) -> None:
        """Add to the counts the rows' accepted and rejected, once for each batch."""
        a = F.col("assertion")
        more = fixed(rows.groupBy(*keys).agg(F.count_if(a == "ACCEPTED").alias("_a"), F.count_if(a == "REJECTED").alias("_r")))
        old = table.of(more).join(more.select(*keys), keys, "left_semi")
        both = more.join(old, keys, "left")
        due = F.coalesce(F.col("batch") < batch, F.lit(True))
        moved = [(F.coalesce(c, F.lit(0)) + F.col(d)).alias(c) for c, d in zip(counts, ("_a", "_r"))]
        table.upsert(both.filter(due).select(*keys, *moved, F.lit(batch).cast("long").alias("batch")), keys)

    def features(self, persons: DataFrame) -> DataFrame:
        """All features of the persons' candidates, by the kept state."""
        who = persons.select("person_id").distinct()
        link, curation = self.link.of(who), self.curation.of(who)
        cand = candidates(self.identity.join(who, "person_id", "left_semi"), self.article.of(link), link, curation)
        cand = with_target(cand.join(link.select(*KEYS, "target_author_index"), KEYS))
        return model.features(cand, curation, state=(self.values.of(who), self.totals.of(who)))

    def stream(self, in_dir: str, checkpoint: str, decisions: Callable[[int], DataFrame], schema: str = ARTICLE) -> StreamingQuery:
        """Work through the Parquet files of articles that the checkpoint hasn't seen, then stop; decisions(batch) gives the
        decisions that go with a batch, the same ones each time it is asked."""
        stream = self.spark.readStream.schema(schema).parquet(in_dir)
        return stream.writeStream.foreachBatch(lambda articles, n: self.apply(articles, decisions(n), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def drop(self) -> None:
        for table in (self.article, self.link, self.curation, self.scores, self.values, self.totals):
            table.drop()
