from pyspark.sql import functions as F

import __spark_entry__ as entry
from namesake.operators import reports

SF = "/root/testdata/sf0.001"


def test_conditions_on_the_found_orcid_keep_the_plan_small(spark):
    """A condition on the found author's id must not carry the cascade that finds the author, once for each mention."""
    plan = entry.queries()["orcid_tiers"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000


def test_shares_are_rounded_as_decimals(spark):
    """Half-even on the share that is meant: 1.45, 1.65 and 2.25 per cent, of which the first as a double is over the tie."""
    rows = spark.createDataFrame([(0.0145,), (0.0165,), (0.0225,), (7250 / 500000,), (None,)], "c double")
    got = [r[0] for r in rows.select(reports.percent(F.col("c"), 1)).collect()]
    assert got == [1.4, 1.6, 2.2, 1.4, None]


def test_name_features_read_kept_rows(spark):
    """The rows are read for their distinct names as well: the cascade that finds the author isn't run again for these."""
    for name in ("derived_identity", "derived_lookups"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan


def test_size_of_author_lists_before_the_window(spark):
    """Counting a person's candidates sorts no lists of authors."""
    plan = entry.queries()["article_author_count"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window [count" in line)
    above = plan[: plan.index(window)]
    assert "size(authors" not in above
