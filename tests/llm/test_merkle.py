import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from namesake.llm.merkle import prove, ranked, report

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, path string, kid int, lo int, root string"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(hashes):
    """All levels from the leaves to the top."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)])
    return levels


def way(levels, at):
    """(left, right) siblings of a leaf, level by level."""
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 16])))
        at //= 16
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault("" if row[3] is None else "=" + row[3], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    names = sorted(groups, key=str.encode)
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    over = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = way(trees[g], i) + way(over, at)
            crc = zlib.crc32(("" if row[0] is None else str(row[0])).encode())
            h = leaf(row, row[1] and row[1].translate(LOWER)) if crc % 5 == 0 else own
            for left, right in path:
                h = sha(left + h + right)
            out.append((row[0], own, trees[g][-1][0], over[-1][0], sha("".join(a + b for a, b in path)), h, h == over[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "g", "p", 1, 2, "r") for r in rows], SCHEMA)


def made(count, sources, seed=0):
    r = random.Random(seed)
    text = lambda i: r.choice([None, "", f"Text {i} É", f"text {i}", "ÀB" * 2000])
    return [(i * 7 - 50, text(i), r.choice(["en", None, ""]), r.choice(sources), r.choice([i, None])) for i in range(count)]


@pytest.mark.parametrize("rows", [
    made(1, ["a"]),
    made(16, ["a"]),
    made(17, ["a"]),
    made(257, ["a", None]),
    made(700, [None, "", "a", "B", "é", "\U0001f600", "￿"] + ["hot"] * 5),
    made(400, [f"s{i}" for i in range(300)]),
    [(None, None, None, None, None)] * 3 + [(5, "Same", "en", "a", 4)] * 40 + [(5, "Other", "en", "a", 4), (None, "A" * 3_000_000, "x", "b", 0)],
], ids=["one", "run", "run and one", "null source", "many bytes", "many sources", "repeated"])
def test_brute_force(spark, rows):
    got = report(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_tampering_shows(spark):
    rows = made(300, ["a", "b", None], 3)
    got = prove(frame(spark, rows), {"n_chars": F.lit(-1)}, F.col("doc_id") % 2 == 0).collect()
    assert all(r.verified == (r.doc_id % 2 != 0) for r in got) and len(got) == 300


def test_places_are_gapless(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 700 as string)) as g", "5 as doc_id", "'x' as h")
    placed, levels = ranked(rows, ["doc_id", "h"])
    seen = {}
    for r in placed.collect():
        seen.setdefault(r.g, []).append(r.lo)
        assert r.hi == r.lo + 1
    assert all(sorted(v) == list(range(len(v))) for v in seen.values()) and len(seen["hot"]) == 1667 and levels == 3


def test_empty(spark):
    assert report(frame(spark, [])).collect() == []
