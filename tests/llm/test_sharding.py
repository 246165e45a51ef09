import zlib
from collections import Counter

from namesake.llm.sharding import shard

SCHEMA = "doc_id long, text string, shard string"


def brute(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_matches_the_published_loop(spark):
    rows = [(i * 7919 - 3000, "täxt" * (i % 5), "x") for i in range(2000)] + [(None, None, "x"), (2**62 + 5, "", "y"), (5, "same", "a"), (5, "same", "a")]
    got = shard(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shard == brute(r.doc_id or 0, 24)
        assert r.grown_shard == brute(r.doc_id or 0, 25) and r.grown_shard in (r.shard, 24)
        assert r.law == "key"
    texts = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert texts == Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_slots_over_several_parts(spark, monkeypatch):
    import namesake.llm.sharding as s

    monkeypatch.setattr(s, "salts_for", lambda n: 7)
    got = s.shard(spark.range(500).selectExpr("id as doc_id", "'a' as text"), 3).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 3


def test_a_very_long_text(spark):
    text = "é" * 2_000_000
    r = shard(spark.createDataFrame([(1, text, "x")], SCHEMA)).first()
    assert (r["size"], r.text_crc32, r.slot) == (4_000_008, zlib.crc32(text.encode()), 0)


def test_empty(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0
