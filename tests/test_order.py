"""Running sums, quantiles, cuts and resamples over sorted ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesake.operators import evaluate, order


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    r = random.Random(1)
    rows = [(g, k, r.randrange(9), r.randrange(9)) for g in "ab" for k in random.Random(g).sample(range(10**6), 700)]
    df = spark.createDataFrame(rows, "g string, k long, x long, y long").repartition(7)
    got = {(t.g, t.k): t for t in order.running(df, F.desc("k") if descending else F.col("k"), ["x", "y"], ["g"]).collect()}
    assert len(got) == len(rows)
    for g in "ab":
        x = y = 0
        for _, k, a, b in sorted((t for t in rows if t[0] == g), key=lambda t: t[1], reverse=descending):
            x, y = x + a, y + b
            assert (got[g, k].x_upto, got[g, k].y_upto) == (x, y)
        assert {(t.x_all, t.y_all) for t in got.values() if t.g == g} == {(x, y)}
    assert got and set(got["a", rows[0][1]].asDict()) == {"g", "k", "x", "y", "x_upto", "y_upto", "x_all", "y_all"}


@pytest.mark.parametrize("share", [0.0, 0.025, 0.5, 0.9, 1.0])
def test_quantiles(spark, share):
    r = random.Random(2)
    rows = [(g, r.choice([r.random(), 0.5, None])) for g in "abb" for _ in range(501)] + [("c", 3.0)]
    got = {t.g: t.v for t in order.quantile(spark.createDataFrame(rows, "g string, v double"), "v", share, ["g"]).collect()}
    for g in "abc":
        assert abs(got[g] - np.quantile([v for h, v in rows if h == g and v is not None], share)) < 1e-12
    whole = order.quantile(spark.createDataFrame(rows, "g string, v double"), "v", share).collect()
    assert abs(whole[0].v - np.quantile([v for _, v in rows if v is not None], share)) < 1e-12
    assert order.quantile(spark.createDataFrame([], "v double"), "v", share).collect() in ([], [(None,)])


def test_exact_shares(spark):
    rows = spark.range(1003).select(F.when(F.col("id") < 900, "a").otherwise("b").alias("g"), F.xxhash64("id").alias("h"))
    cut = order.lowest(rows, "h", 0.8, ["g"]).withColumnRenamed("h", "cut")
    got = {t.g: t["count"] for t in rows.join(cut, "g").filter("h <= cut").groupBy("g").count().collect()}
    assert got == {"a": 720, "b": 82}


@pytest.mark.parametrize("n", [1, 2, 10, 10**6])
def test_weights_are_poisson(n):
    draws = np.concatenate([evaluate.resampled(n, 1000, key, 7) for key in range(40)])
    assert abs(draws.mean() - n) < 4 * (n / len(draws)) ** 0.5
    assert abs(draws.var() / n - 1) < 4 * (2 / len(draws) + 1 / n / len(draws)) ** 0.5
    assert (evaluate.resampled(n, 50, -3, 7) == evaluate.resampled(n, 50, -3, 7)).all() and (evaluate.resampled(n, 50, 1, 7) != evaluate.resampled(n, 50, 2, 7)).any()


def test_interval_as_by_a_plain_bootstrap(spark):
    r = np.random.default_rng(5)
    label = r.random(600) < 0.3
    score = np.round(r.normal(50, 10, 600) + 8 * label, 1)

    def area(s, y):
        p, q = np.sort(s[y]), np.sort(s[~y])
        return (np.searchsorted(q, p, "left").sum() + np.searchsorted(q, p, "right").sum()) / 2 / len(p) / len(q)

    plain = [area(score[i], label[i]) for i in (r.integers(0, 600, 600) for _ in range(2000))]
    rows = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")
    got = evaluate.bootstrap_ci(rows, 2000).first()
    want = np.quantile(plain, [0.025, 0.975])
    width = want[1] - want[0]
    assert abs(got.low - want[0]) < 0.1 * width and abs(got.high - want[1]) < 0.1 * width and got.resamples == 2000
    assert tuple(evaluate.bootstrap_ci(rows.repartition(13), 2000).first()) == pytest.approx(tuple(got), abs=1e-9)
    one = evaluate.bootstrap_ci(rows.filter("label = 1"), 50).first()
    assert (one.low, one.high, one.resamples) == (None, None, 0)


def test_curve_reads_its_rows_once(spark, tmp_path):
    """Two scans are planned over a fixed table of sorted ranges, none over the scores themselves."""
    spark.range(1000).selectExpr("cast(id % 97 as double) as score", "cast(id % 3 = 0 as int) as label").write.parquet(str(tmp_path / "s"))
    plan = evaluate.roc_auc(spark.read.parquet(str(tmp_path / "s")))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and plan.count("Scan ExistingRDD") == 2
