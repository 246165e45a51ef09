import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from namesake.llm import line_dedup
from namesake.llm.line_dedup import Runs, common_lines, deduplicate, report

SCHEMA = "doc_id long, text string, a string, n int, at string, batch string, gone string"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)


def brute(rows, enough=10):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    common = {k for k, n in seen.items() if k and n >= enough}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", None) for r in rows], SCHEMA)


def made(seed=0, count=300):
    r = random.Random(seed)
    shared = ["All rights reserved", " ALL rights\treserved ", "Éa", "éA", " menu", "menu\x0b", "a", "", "   ", "x" * 3000]
    rows = []
    for i in range(count):
        lines = [r.choice(shared) if r.random() < 0.3 else f"line {r.randrange(200)}" for _ in range(r.randrange(8))]
        rows.append((i, "\n".join(lines)))
    rows += [(None, None), (None, ""), (5, "\n"), (5, "\n"), (7, None), (8, "\n".join(f"long {i}" for i in range(30_000)) + "\nmenu\n")]
    rows += [(1000 + i, "copied text\nmenu") for i in range(12)] + [(2000, "in ten")] * 10 + [(3000 + i, "in nine") for i in range(9)]
    return rows


def test_brute_force(spark):
    rows = made()
    got = deduplicate(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    digests = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in report(frame(spark, rows)).collect())
    assert digests == Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows))


@pytest.mark.parametrize("enough,batches", [(1, 3), (2, 7), (10, 1), (25, 8)])
def test_thresholds_and_levels(spark, enough, batches):
    rows = made(1)
    got = deduplicate(frame(spark, rows), enough, batches).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, enough)


def test_joins_without_broadcast(spark):
    """The same rows where nothing is small enough to be broadcast."""
    rows = made(2)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = deduplicate(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_batches_that_arrive_one_by_one(spark):
    """Keys settle as batches arrive; what is settled isn't counted again, and the counts add up over levels."""
    batches = [made(seed, 60) for seed in range(5)]
    runs = Runs(spark, 10, 3)
    for rows in batches:
        runs.add(line_dedup.document_counts(frame(spark, rows)))
    assert [len(level) for level in runs.levels] == [1, 0, 1] and len(runs.settled) == 1
    seen = Counter(k for rows in batches for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    common = {k for k, n in seen.items() if k and n >= 10}
    want = spark.createDataFrame([(k,) for k in common], "key string").select(*line_dedup.hashes(F.col("key")))
    assert sorted(map(tuple, runs.close().collect())) == sorted(map(tuple, want.collect()))


def test_merges_need_no_shuffle(spark):
    runs = Runs(spark, 10, 4)
    names = [runs.write(line_dedup.document_counts(frame(spark, made(s, 50))).repartition(4, "a", "b")) for s in (0, 1)]
    plan = runs.merged(*names)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_empty(spark):
    assert report(frame(spark, [])).collect() == []
    assert common_lines(frame(spark, [(1, None), (2, "")])).collect() == []
