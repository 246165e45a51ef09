"""Upkeep of stored tables: merges, upserts and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, keys: list[str], policy: str = "overwrite", order: str | None = None) -> DataFrame:
    """The target with the source's rows put in.

    policy 'overwrite': a source row takes the place of the target's; of several with one key the last by `order`
    counts. 'keep': the target's row stays, and of several source rows the first counts. Rows that `order` doesn't part
    are taken by a hash of their values, so that a second run gives the same. Columns that only one side has stay
    and are null in the other's rows. Both sides are exchanged and sorted once, together.
    """
    old_first = policy == "keep"
    order_added = order is not None and order not in target.columns
    lone = F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), F.col("_new"))  # a null key meets nothing
    kept_only = [c for c in target.columns if c not in source.columns and not old_first]
    old = target.withColumns({"_new": F.lit(False), "_tie": F.lit(0).cast("long")})
    new = source.withColumns({"_new": F.lit(True), "_tie": F.xxhash64(*source.columns)})
    rows = in_parts(old.unionByName(new, allowMissingColumns=True), *keys).withColumn("_lone", lone)
    place = [] if order is None else [F.asc(order) if old_first else F.desc(order)]
    by = Window.partitionBy(*keys, "_lone").orderBy(F.asc("_new") if old_first else F.desc("_new"), *place, "_tie")
    rows = rows.withColumns({"_n": F.row_number().over(by), "_first": F.first("_new").over(by)})
    if kept_only:
        theirs = F.first(F.when(~F.col("_new"), F.struct(*kept_only)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # the same sort
        rows = rows.withColumn("_theirs", theirs).withColumns({c: F.when(F.col("_new"), F.col(f"_theirs.{c}")).otherwise(F.col(c)) for c in kept_only})
    wins = F.col("_first") & (F.col("_n") == 1)
    kept = ~F.col("_new") | wins if old_first else ~F.col("_first") | wins
    return rows.filter(kept).drop("_new", "_tie", "_lone", "_n", "_first", "_theirs", *([order] if order_added else []))


def in_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows exchanged by the keys into twice the session's number of shuffle partitions, which aren't put together again:
    rows that compress well would else be sorted by a few tasks, whose memory grows with the table."""
    return rows.repartition(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def upsert_identities(identity: DataFrame, roster: DataFrame) -> DataFrame:
    """Identities with a roster's rows in place of their own; of a person's rows the last by position counts."""
    return merge(identity, roster, ["person_id"], "overwrite", "position")


def insert_articles(article: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Articles and the new ones that weren't there; stored ones never change."""
    return merge(article, new, ["pmid"], "keep", order)


def link_uploads(link: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links with the imported pairs as 'upload' where there was none."""
    return merge(link, pairs.select("person_id", "pmid", F.lit("upload").alias("source")), ["person_id", "pmid"], "keep")


def link_found(link: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links with the pairs that a search found, whose source becomes 'search' in any case."""
    return merge(link, pairs.select("person_id", "pmid", F.lit("search").alias("source")), ["person_id", "pmid"], "overwrite")


def upsert_scores(score: DataFrame, new: DataFrame) -> DataFrame:
    """Scores with new ones in place of those of the same person, article and model type; the latest scored_at counts."""
    return merge(score, new, ["person_id", "pmid", "model_type"], "overwrite", "scored_at")


def known_only(rows: DataFrame, article: DataFrame) -> DataFrame:
    """Only rows of articles that exist."""
    return rows.join(article.select("pmid"), "pmid", "left_semi")


def invalidate(scores: DataFrame, new_curation: DataFrame) -> DataFrame:
    """Scores without those of persons who got a new decision."""
    return scores.join(new_curation.select("person_id").distinct(), "person_id", "left_anti")


def cascade_delete(tables: dict[str, DataFrame], persons: DataFrame) -> dict[str, DataFrame]:
    """The tables that have a person_id without the persons' rows; the others as they are."""
    gone = persons.select("person_id").distinct()
    return {k: df.join(gone, "person_id", "left_anti") if "person_id" in df.columns else df for k, df in tables.items()}


def update_retrieval_log(log: DataFrame, run: DataFrame) -> DataFrame:
    """run: person_id, retrieved_on, articles_found, run_id, orcid_ran. The ORCID date moves only if that ran."""
    old = log.select("person_id", F.col("last_orcid_retrieval_date").alias("_old"))
    rows = run.join(old, "person_id", "left").select(
        "person_id", F.col("retrieved_on").alias("last_retrieval_date"),
        F.when(F.col("orcid_ran"), F.col("retrieved_on")).otherwise(F.col("_old")).alias("last_orcid_retrieval_date"), "articles_found", "run_id",
    )
    return merge(log, rows, ["person_id"])


def wipe(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty tables, and how many rows each had."""
    spark = next(iter(tables.values())).sparkSession
    counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("deleted")) for name, df in tables.items()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return {k: spark.createDataFrame([], df.schema) for k, df in tables.items()}, total
