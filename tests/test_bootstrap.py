"""The registered interval has the whole number of resamples."""

from namesake.plans.catalogue import QUERIES


def test_whole_number_of_resamples(spark):
    r = QUERIES["bootstrap_ci"](spark, "/root/testdata/sf0.001").first()
    assert r.resamples == 1000 and 0 <= r.low < r.high <= 1
