"""Retrieval by name at the production thresholds, and each of its branches at small ones, against SQL."""

import datetime
from collections import Counter

import duckdb
import pytest

from namesake.operators import retrieve
from namesake.params import Params
from namesake.plans import report_queries as rq
from namesake.plans.catalogue import ORACLE, QUERIES
from namesake.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"
NAMES = ["retrieval_decisions", "candidates_cascade", "candidates_orcid_union", "incremental_window"]


def answers(sql):
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(sql)
    return [c[0] for c in out.description], sorted(out.fetchall(), key=str)


def rows(df, columns):
    assert sorted(df.columns) == sorted(columns)
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_production_thresholds(spark, name):
    assert "> 3000" in ORACLE[f"{name}_default"] and "<= 1500" in ORACLE[f"{name}_default"]
    columns, want = answers(ORACLE[f"{name}_default"])
    assert want and rows(QUERIES[f"{name}_default"](spark, SF), columns) == want


@pytest.mark.parametrize("name, sql", zip(NAMES, [rq.DECISIONS, rq.CASCADE, rq.UNION, rq.WINDOW]))
def test_every_branch(spark, name, sql):
    cfg = Params(lenient_threshold=60, strict_threshold=30)
    columns, want = answers(rq.index_sql(cfg) + sql)
    assert rows(getattr(rq, name)(Tables(spark, SF), cfg), columns) == want
    if name == "retrieval_decisions":
        assert Counter(r[columns.index("query_type")] for r in want) == {"lenient": 42, "strict": 45, "skipped": 63}


def test_articles_are_read_once(spark):
    """What is found comes from the kept matches; update mode reads the dates from there too."""
    for ask in (rq.candidates_orcid_union, rq.incremental_window):
        plan = ask(Tables(spark, SF), Params())._jdf.queryExecution().optimizedPlan().toString()
        assert "l_partkey" not in plan


def test_repeated_articles_and_missing_names(spark):
    """A repeated article or author counts once; persons without a name, or an ORCID, find nothing by it."""
    author = "array<struct<first_name:string,last_name:string,orcid:string>>"
    ann, bob = ("Ann", "Lee", None), ("Bob", "Lee", "0000-0001")
    listed = [(1, [ann, ann]), (1, [ann, ann]), (2, [("A.", "Lee", ""), bob]), (3, []), (4, None), (5, [(None, None, None), ("", "", "")])]
    articles = spark.createDataFrame(listed, f"pmid long, authors {author}")
    people = spark.createDataFrame([("p", "Ann", "Lee", ""), ("q", "Bob", "Lee", "https://orcid.org/0000-0001"), ("r", "", "", None), ("s", None, None, "")], "person_id string, first_name string, last_name string, orcid string")
    index = retrieve.author_index(articles)
    pairs = lambda df: sorted((r.person_id, r.pmid) for r in df.collect())
    found, decisions = retrieve.retrieve_by_name(people, index, Params(lenient_threshold=1, strict_threshold=1))
    assert pairs(found) == [("p", 1), ("q", 2)]
    assert {r.person_id: (r.query_type, r.lenient_count, r.strict_count) for r in decisions.collect()} == {"p": ("strict", 2, 1), "q": ("lenient", 1, None), "r": ("lenient", 0, None), "s": ("lenient", 0, None)}
    assert pairs(retrieve.retrieve_by_orcid(people, index)) == [("q", 2)]
    links = spark.createDataFrame([("p", 1)], "person_id string, pmid long")
    assert pairs(retrieve.retrieve(people, articles, links)) == [("p", 2), ("q", 2)]
    assert retrieve.retrieve(people, articles, links, mode="score_only").columns == ["person_id", "pmid", "source"]
    assert retrieve.retrieve(people, articles.limit(0), links).count() == 0


def test_pairs_found_twice(spark):
    """A pair that comes by name and by ORCID is given once, also where only one of the days lets it through; pairs are
    not exchanged again once they are made."""
    author = "array<struct<first_name:string,last_name:string,orcid:string>>"
    bob = ("Bob", "Lee", "1")
    day = lambda n: datetime.date(2000, 1, n)
    articles = spark.createDataFrame([(1, day(5), None, [bob]), (1, day(9), None, [bob]), (2, day(5), day(2), [bob, ("Bob", "Lee", "")]), (3, None, day(5), [("Al", "Ox", "1")])], f"pmid long, entry_date date, pub_date date, authors {author}")
    people = spark.createDataFrame([("p", "Bob", "Lee", "1"), ("q", "B", "Lee", "1"), ("r", "Bob", "Lee", ""), ("p", "Bob", "Lee", "1")], "person_id string, first_name string, last_name string, orcid string")
    links = spark.createDataFrame([("q", 2), ("r", 3), ("r", 2)], "person_id string, pmid long")
    found = retrieve.retrieve(people, articles, links)
    pairs = lambda df: sorted((r.person_id, r.pmid) for r in df.collect())
    assert pairs(found) == [("p", 1), ("p", 2), ("p", 3), ("q", 1), ("q", 3), ("r", 1)]
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    log = spark.createDataFrame([("p", day(6), day(1)), ("q", None, day(9)), ("r", day(10), None)], "person_id string, last_retrieval_date date, last_orcid_retrieval_date date")
    assert pairs(retrieve.retrieve(people, articles, links, log, "update")) == [("p", 1), ("p", 2), ("p", 3), ("q", 1)]
