"""The update by kept state against one run over everything."""

import uuid

import pytest
from pyspark.sql import functions as F

from namesake.operators import candidates, model, retrieve, target
from namesake.params import Params
from namesake.plans.fixtures import Tables
from namesake.streaming.update import Updates

SF = "/root/testdata/sf0.001"
CFG = Params(lenient_threshold=10**9)  # by the first initial, whatever a batch holds
COLUMNS = [c for c in model.FEEDBACK if c not in ("feedbackScoreTextSimilarity", "feedbackScoreJournalTitleSimilarity", "feedbackScoreBibliographicCoupling")]


def scored(rows):
    """A stand-in for a model that moves with every feature."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * (k + 1) for k, c in enumerate(COLUMNS)), F.lit(0.0))
    return rows.select("person_id", "pmid", F.lit("feedbackIdentity").alias("model_type"), total.alias("raw_score"), F.round(total, 6).alias("calibrated_score"))


def result(df):
    return {(r.person_id, r.pmid): r.calibrated_score for r in df.collect()}


@pytest.fixture
def tables(spark):
    t = Tables(spark, SF)
    identity = t.identity.filter("cast(person_id as long) % 40 = 1").persist()
    index = retrieve.author_index(t.article)
    found = retrieve.retrieve_by_name(identity, index, CFG)[0].persist()
    article = t.article.withColumn("entry_date", F.lit(None).cast("date")).join(found.select("pmid").distinct(), "pmid", "left_semi")
    schema = article.schema
    article = spark.createDataFrame(article.collect(), schema)
    found = retrieve.retrieve(identity, article, spark.createDataFrame([], "person_id string, pmid long"), cfg=CFG)
    found = spark.createDataFrame(found.collect(), found.schema)
    # Decisions on candidates, and some on pairs that are never linked.
    marks = found.filter("pmid % 3 > 0").select("person_id", "pmid", F.when(F.col("pmid") % 3 == 1, "ACCEPTED").otherwise("REJECTED").alias("assertion"))
    marks = marks.unionByName(t.curation.limit(10)).dropDuplicates(["person_id", "pmid"])
    marks = spark.createDataFrame(marks.collect(), marks.schema)
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"}  # few rows, long plans
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield identity, article, found, marks
    for k, v in old.items():
        spark.conf.set(k, v)
    identity.unpersist()


def test_three_batches_and_a_repeat(spark, tables):
    identity, article, found, marks = tables
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in article.schema)
    job = Updates(spark, f"u_{uuid.uuid4().hex}", identity, scored, CFG, 2, schema)
    try:
        # A decision comes a batch after its article, with it, or before it.
        part = lambda k: (article.filter(F.col("pmid") % 5 % 3 == k), marks.filter((F.col("pmid") + F.col("person_id").cast("long")) % 3 == k))
        for k in (0, 1, 1, 2):
            job.apply(*part(k), k)
        resolved = target.with_target(target.resolve_target_author(candidates.candidates(identity, article, found, marks)))
        want = result(scored(model.features(resolved, marks)))
        got = result(job.scores.read())
        assert len(want) > 30 and want.keys() == got.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
        # A batch that broke off after the state goes on, and adds nothing twice; decisions that come later than all else count.
        score, job.score = job.score, lambda rows: 1 / 0
        extra = found.join(marks, ["person_id", "pmid"], "left_anti").select("person_id", "pmid", F.lit("REJECTED").alias("assertion"))
        with pytest.raises(ZeroDivisionError):
            job.apply(article.limit(0), extra, 3)
        job.score = score
        job.apply(article.limit(0), extra, 3)
        more = marks.unionByName(extra)
        again = result(scored(model.features(target.with_target(target.resolve_target_author(candidates.candidates(identity, article, found, more))), more)))
        final = result(job.scores.read())
        assert all(final[k] == pytest.approx(again[k], abs=1e-5) for k in again) and again != want
    finally:
        job.drop()
