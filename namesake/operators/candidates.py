"""Persons with their articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(identity: DataFrame, article: DataFrame, link: DataFrame, curation: DataFrame, person: str | None = None) -> DataFrame:
    """A row per person and linked article: both sides' columns, source, and assertion ('' where there is none)."""
    if person is not None:
        identity, link, curation = (df.filter(F.col("person_id") == person) for df in (identity, link, curation))
    marks = curation.select("person_id", "pmid", "assertion")
    rows = link.select("person_id", "pmid", "source").join(identity, "person_id").join(marks, ["person_id", "pmid"], "left")
    return rows.join(article.drop("source"), "pmid").withColumn("assertion", F.coalesce("assertion", F.lit("")))


def listing(df: DataFrame) -> DataFrame:
    """Newest first, the highest pmid first within a year."""
    return df.orderBy(F.desc("pub_year"), F.desc("pmid"))


def trimmed_assertions(df: DataFrame, ends: int = 2) -> DataFrame:
    """(person_id, pmid, assertion) of candidates: all rejected ones, and the accepted ones without each person's
    `ends` oldest and newest by date, then pmid. Takes pub_date."""
    from pyspark.sql import Window

    accepted = df.filter("assertion = 'ACCEPTED'")
    by = Window.partitionBy("person_id")
    old = F.row_number().over(by.orderBy("pub_date", "pmid"))
    new = F.row_number().over(by.orderBy(F.desc("pub_date"), F.desc("pmid")))
    kept = accepted.withColumns({"_old": old, "_new": new}).filter((F.col("_old") > ends) & (F.col("_new") > ends))
    columns = ["person_id", "pmid", "assertion"]
    return kept.select(columns).unionByName(df.filter("assertion = 'REJECTED'").select(columns))
