"""Tables in parts and buckets: upserts touch their parts only, joins by the key need no shuffle."""

import uuid

import pytest
from pyspark.sql import functions as F

from namesake.sources.stored import Stored
from namesake.sources.tables import merge


@pytest.fixture
def table(spark):
    made = []

    def make(schema="person_id string, pmid long, v string", **options):
        made.append(Stored(spark, f"t_{uuid.uuid4().hex}", schema, buckets=4, **options))
        return made[-1]

    yield make
    for t in made:
        t.drop()


def rows(spark, pairs, v):
    return spark.createDataFrame([(p, i, v) for p, i in pairs], "person_id string, pmid long, v string")


def contents(df):
    return sorted(map(tuple, df.collect()))


def test_upserts_as_merges(spark, table):
    t = table(parts=5)
    now = rows(spark, [], "")
    for n, policy in enumerate(["overwrite", "keep", "overwrite", "overwrite"]):
        new = rows(spark, [(str(i % 40), i) for i in range(n * 30, n * 30 + 60)], f"v{n}")
        t.upsert(new, ["person_id", "pmid"], policy)
        now = merge(now, new, ["person_id", "pmid"], policy)
        assert contents(t.read()) == contents(now)
    t.upsert(new.limit(0), ["person_id", "pmid"])
    assert contents(t.read()) == contents(now)
    assert contents(t.of(rows(spark, [("3", 0), ("7", 0), ("none", 0)], ""))) == contents(now.filter("person_id in ('3', '7')"))


def test_untouched_parts_keep_their_files(spark, table):
    t = table(parts=8)
    t.upsert(rows(spark, [(str(i), i) for i in range(200)], "a"), ["person_id"])
    part = {r.person_id: r.p for r in t.read().select("person_id", F.pmod(F.xxhash64("person_id"), F.lit(8)).alias("p")).collect()}
    before = set(spark.table(t.name).inputFiles())
    t.upsert(rows(spark, [("5", 1)], "b"), ["person_id"])
    after = set(spark.table(t.name).inputFiles())
    same = lambda files: {f for f in files if f"part={part['5']}/" not in f}
    assert same(before) == same(after) and before != after and len(same(before)) > 7
    assert t.read().filter("v = 'b'").count() == 1 and t.read().count() == 200


def test_deletes_empty_parts_too(spark, table):
    t = table(parts=3)
    t.upsert(rows(spark, [(str(i), i) for i in range(30)], "a"), ["person_id"])
    t.delete(rows(spark, [(str(i), 0) for i in range(29)], ""))
    assert contents(t.read()) == [("29", 29, "a")]
    t.delete(rows(spark, [("29", 0)], ""))
    assert contents(t.read()) == []


def test_joins_by_the_key_need_no_shuffle(spark, table):
    a, b = table(parts=2), table("person_id string, w string", parts=2)
    a.upsert(rows(spark, [(str(i), i) for i in range(100)], "a"), ["person_id"])
    b.upsert(spark.createDataFrame([(str(i), "w") for i in range(100)], "person_id string, w string"), ["person_id"])
    joined = a.read().hint("merge").join(b.read(), "person_id").groupBy("person_id").agg(F.count("*").alias("n"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 100
