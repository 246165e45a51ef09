"""The generated tables as identities, articles, links, curations and scores; as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.tables import in_parts

#: Authors of an article (the first) are placed by the others.
PLACE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


class Tables:
    """Frames made of the tables in a folder, each when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self.spark = spark

    @property
    def identity(self) -> DataFrame:
        n = self.read("supplier").agg(F.count("*").alias("suppliers"))
        rows = self.read("customer").join(self.read("part"), F.expr("p_partkey = c_custkey")).join(F.broadcast(self.read("nation")), F.expr("n_nationkey = c_nationkey"))
        return rows.join(F.broadcast(n)).selectExpr(
            "cast(c_custkey as string) as person_id",
            "concat(split(p_name, ' ')[0], case when c_custkey % 4 = 0 then 'a' when c_custkey % 4 = 1 then 'en' else '' end) as first_name",
            "split(p_name, ' ')[1] as last_name",
            "case when c_custkey % 3 = 0 then split(p_type, ' ')[0] else '' end as middle_name",
            "case when c_custkey % 5 = 0 then '' else concat('user', c_custkey, '@mail.example.com') end as primary_email",
            "n_name as primary_institution",
            "c_mktsegment as department",
            "'' as title",
            "case when c_custkey % 3 = 1 then lpad(cast(c_custkey % suppliers as string), 16, '0') else '' end as orcid",
            "cast(case when c_custkey % 2 = 0 then 1975 + c_custkey % 20 else 0 end as int) as bachelor_year",
            "cast(case when c_custkey % 6 = 0 then 1980 + c_custkey % 20 else 0 end as int) as doctoral_year",
        )

    @property
    def author(self) -> DataFrame:
        """One row per author: pmid, idx and the author's fields, with the article's keyword."""
        return self._placed().drop("o_orderdate", *PLACE)

    @property
    def listed(self) -> DataFrame:
        """What a search reads of the articles, as a row per author: no lists are made."""
        whole = Window.partitionBy(PLACE[0])
        return self._placed().select("pmid", "last_name", "first_name", "orcid", F.max("l_shipdate").over(whole).cast("date").alias("entry_date"), F.col("o_orderdate").cast("date").alias("pub_date"))

    def _placed(self, spread: bool = False) -> DataFrame:
        """The authors with the columns by which they are partitioned and sorted. Parts and suppliers are joined first, so
        that the rows are exchanged by article once, for all that follows; with spread into parts that aren't put together again."""
        place = Window.partitionBy(PLACE[0]).orderBy(*PLACE[1:])
        parts = self.read("part").selectExpr("p_partkey", "p_type", "p_brand", "split(p_name, ' ')[0] as f", "split(p_name, ' ')[1] as l")
        rows = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").join(parts, F.expr("p_partkey = l_partkey"))
        rows = rows.join(self.read("supplier").select("s_suppkey", "s_nationkey"), F.expr("s_suppkey = l_suppkey")).join(F.broadcast(self.read("nation").select("n_nationkey", "n_name")), F.expr("n_nationkey = s_nationkey"))
        rows = in_parts(rows, PLACE[0]) if spread else rows
        rows = rows.join(self.read("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.expr("o_orderkey = l_orderkey")).withColumn("idx", F.row_number().over(place) - 1)
        return rows.selectExpr(
            "l_orderkey as pmid",
            "idx",
            "case when p_partkey % 11 = 0 then l when p_partkey % 5 = 0 then substring(f, 1, 1) when p_partkey % 4 = 0 then concat(f, 'a') else f end as first_name",
            "case when p_partkey % 11 = 0 then f when p_partkey % 7 = 0 and length(l) >= 5 then substring(l, 1, length(l) - 1) when p_partkey % 13 = 0 then concat('mc', l) else l end as last_name",
            "concat(upper(substring(f, 1, 1)), case when p_partkey % 2 = 0 then upper(substring(p_type, 1, 1)) else '' end) as initials",
            "concat(n_name, ', ', p_type, case when p_partkey % 17 = 0 then concat(' user', o_custkey, '@mail.example.com') else '' end) as affiliation",
            "case when l_suppkey % 2 = 0 then lpad(cast(l_suppkey as string), 16, '0') else '' end as orcid",
            "p_brand as keyword",
            "l_shipdate",
            "o_orderdate",
            *PLACE,
        )

    @property
    def article(self) -> DataFrame:
        fields = ["idx", "first_name", "last_name", "initials", "affiliation", "orcid"]
        whole = Window.partitionBy(PLACE[0]).orderBy(*PLACE[1:]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one sort
        nested = self._placed(spread=True).select(
            "pmid",
            "idx",
            F.collect_list(F.struct(*fields, F.col("first_name").alias("fore_name"))).over(whole).alias("authors"),
            F.array_sort(F.collect_set("keyword").over(whole)).alias("keywords"),
            F.max("l_shipdate").over(whole).cast("date").alias("entry_date"),
        ).filter("idx = 0").drop("idx")
        orders = self.read("orders").selectExpr("o_orderkey as pmid", "o_orderpriority as journal", "year(o_orderdate) as pub_year", "cast(o_orderdate as date) as pub_date")
        return orders.join(nested, "pmid", "left").withColumn("authors", F.coalesce("authors", F.array().cast(nested.schema["authors"].dataType)))

    @property
    def link(self) -> DataFrame:
        return self.read("orders").selectExpr("cast(o_custkey as string) as person_id", "o_orderkey as pmid", "case when o_orderkey % 2 = 0 then 'upload' else 'search' end as source")

    @property
    def curation(self) -> DataFrame:
        rows = self.read("orders").filter("o_orderstatus in ('F', 'P')")
        return rows.selectExpr("cast(o_custkey as string) as person_id", "o_orderkey as pmid", "case when o_orderstatus = 'F' then 'ACCEPTED' else 'REJECTED' end as assertion")

    @property
    def score(self) -> DataFrame:
        rows = in_parts(self.read("orders"), "o_custkey").selectExpr("o_custkey", "cast(o_custkey as string) as person_id", "o_orderkey as pmid", "o_totalprice / 500000 as calibrated_score", "o_orderstatus in ('F', 'P') as curated")
        any_curated = F.max("curated").over(Window.partitionBy("o_custkey"))
        first = rows.withColumn("model_type", F.when(any_curated, "feedbackIdentity").otherwise("identityOnly")).drop("curated", "o_custkey")
        second = first.filter("pmid % 3 = 0 and model_type = 'feedbackIdentity'").withColumn("model_type", F.lit("identityOnly")).withColumn("calibrated_score", F.col("calibrated_score") * 0.9)
        return first.unionByName(second)


#: The same in DuckDB SQL: common table expressions to put in front of a query.
SQL = r"""
WITH identity AS (
  SELECT c_custkey::VARCHAR AS person_id,
         split_part(p_name, ' ', 1) || CASE WHEN c_custkey % 4 = 0 THEN 'a' WHEN c_custkey % 4 = 1 THEN 'en' ELSE '' END AS first_name,
         split_part(p_name, ' ', 2) AS last_name,
         CASE WHEN c_custkey % 3 = 0 THEN split_part(p_type, ' ', 1) ELSE '' END AS middle_name,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'user' || c_custkey || '@mail.example.com' END AS primary_email,
         n_name AS primary_institution, c_mktsegment AS department,
         CASE WHEN c_custkey % 3 = 1 THEN lpad((c_custkey % (SELECT count(*) FROM supplier))::VARCHAR, 16, '0') ELSE '' END AS orcid,
         (CASE WHEN c_custkey % 2 = 0 THEN 1975 + c_custkey % 20 ELSE 0 END)::INT AS bachelor_year,
         (CASE WHEN c_custkey % 6 = 0 THEN 1980 + c_custkey % 20 ELSE 0 END)::INT AS doctoral_year
  FROM customer JOIN part ON p_partkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
raw_author AS (
  SELECT l_orderkey AS pmid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx,
         split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l, *
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
       JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
author AS (
  SELECT pmid, idx,
         CASE WHEN p_partkey % 11 = 0 THEN l WHEN p_partkey % 5 = 0 THEN f[1] WHEN p_partkey % 4 = 0 THEN f || 'a' ELSE f END AS first_name,
         CASE WHEN p_partkey % 11 = 0 THEN f WHEN p_partkey % 7 = 0 AND length(l) >= 5 THEN l[:length(l) - 1] WHEN p_partkey % 13 = 0 THEN 'mc' || l ELSE l END AS last_name,
         upper(f[1]) || CASE WHEN p_partkey % 2 = 0 THEN upper(p_type[1]) ELSE '' END AS initials,
         n_name || ', ' || p_type || CASE WHEN p_partkey % 17 = 0 THEN ' user' || o_custkey || '@mail.example.com' ELSE '' END AS affiliation,
         CASE WHEN l_suppkey % 2 = 0 THEN lpad(l_suppkey::VARCHAR, 16, '0') ELSE '' END AS orcid,
         p_brand AS keyword, l_shipdate
  FROM raw_author),
article AS (
  SELECT o_orderkey AS pmid, o_orderpriority AS journal, year(o_orderdate) AS pub_year, o_orderdate::DATE AS pub_date, n_authors, entry_date
  FROM orders LEFT JOIN (SELECT pmid, count(*) AS n_authors, max(l_shipdate)::DATE AS entry_date FROM author GROUP BY pmid) x ON x.pmid = o_orderkey),
link AS (
  SELECT o_custkey::VARCHAR AS person_id, o_orderkey AS pmid, CASE WHEN o_orderkey % 2 = 0 THEN 'upload' ELSE 'search' END AS source FROM orders),
curation AS (
  SELECT o_custkey::VARCHAR AS person_id, o_orderkey AS pmid, CASE WHEN o_orderstatus = 'F' THEN 'ACCEPTED' ELSE 'REJECTED' END AS assertion
  FROM orders WHERE o_orderstatus IN ('F', 'P')),
first_score AS (
  SELECT person_id, pmid, CASE WHEN any_curated THEN 'feedbackIdentity' ELSE 'identityOnly' END AS model_type, calibrated_score
  FROM (SELECT o_custkey::VARCHAR AS person_id, o_orderkey AS pmid, o_totalprice / 500000 AS calibrated_score,
               bool_or(o_orderstatus IN ('F', 'P')) OVER (PARTITION BY o_custkey) AS any_curated FROM orders)),
score AS (
  SELECT * FROM first_score
  UNION ALL SELECT person_id, pmid, 'identityOnly', calibrated_score * 0.9 FROM first_score WHERE pmid % 3 = 0 AND model_type = 'feedbackIdentity'),
cand AS (
  SELECT i.*, a.pmid, a.journal, a.pub_year, a.pub_date, a.n_authors, a.entry_date, l.source, coalesce(c.assertion, '') AS assertion
  FROM identity i JOIN link l USING (person_id) JOIN article a USING (pmid) LEFT JOIN curation c ON c.person_id = i.person_id AND c.pmid = a.pmid)
"""
