import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesake.llm import near_dups
from namesake.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


CONTRACT = {"percent": 85, "size": 3, "count": 48, "rows": 7}


def brute(docs, percent=85, size=3):
    def runs(text):
        w = WORD.findall((text or "").translate(LOWER))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    sets = [(i, runs(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and top(i) != top(j):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)] + ["É", "x y"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 60, 200]))) for _ in range(150)]
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(120):  # a family in which most pairs are under the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append(" ".join(copy))
    chain = list(base[:80])
    for _ in range(15):  # each links with the next only
        chain = [*chain[2:], rng.choice(words), rng.choice(words)]
        docs.append("\n".join(chain))
    docs += [docs[3]] * 30 + [docs[3].upper(), None, "", "  \n", "one two", "ONE two", "one  two "]
    rng.shuffle(docs)
    return [(3 * i + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("unit", [1 << 17, 2000])
def test_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(near_dups, "UNIT_SHINGLES", unit)
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("nid", F.lit("clash"))
    assert sorted(tuple(r) for r in near_dups.find(frame).collect()) == brute(docs, 80, 5)
    got = sorted(tuple(r) for r in near_dups.find(frame, **CONTRACT).collect())
    assert got == brute(docs)
    left = near_dups.deduplicate(frame, **CONTRACT)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == [r[0] for r in brute(docs) if r[3]]


def test_null_and_repeated_ids(spark):
    docs = [(5, "a b c d"), (None, "a b c d"), (None, "z z z q"), (9, "a b c d"), (9, "a b c d"), (7, None)]
    got = near_dups.find(spark.createDataFrame(docs, "doc_id long, text string"), **CONTRACT).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 2, 5, True), (None, 2, 5, False), (None, 2, None, False), (9, 2, 5, False), (9, 2, 5, False), (7, 0, 7, True)], key=str)
    assert near_dups.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_agree_like_the_sets():
    rng = np.random.default_rng(4)
    for n in (3, 50, 2000):
        items = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = np.unique(items[: int(1.5 * n)]), np.unique(items[n // 2 :])
        rates = []
        for _ in range(20):
            mask = np.uint64(rng.integers(0, 1 << 63))
            s = near_dups.sketches([near_dups.mix(a ^ mask), near_dups.mix(b ^ mask)], 256)
            assert not (s == near_dups.FULL).any()
            rates.append((s[0] == s[1]).mean())
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(rates) - truth) < 0.12 if n == 3 else abs(np.mean(rates) - truth) < 0.03


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: parent[x] for x in linked}


def test_units_are_bounded_by_sets(spark):
    sizes = {i: 13 + i % 3 for i in range(12_000)}  # a template with a varying word: many sets, few shingles
    members = spark.createDataFrame([(i, 1, n) for i, n in sizes.items()], "nid long, family long, n long")
    units = near_dups.place(members, 85).groupBy("unit").agg(F.collect_list("nid").alias("nids")).collect()
    assert max(len(r.nids) for r in units) < 2.3 * near_dups.UNIT_SETS
    places = [set() for _ in sizes]
    for k, r in enumerate(units):
        for i in r.nids:
            places[i].add(k)
    rng = random.Random(3)
    assert all(places[a] & places[b] for a, b in (rng.sample(range(12_000), 2) for _ in range(5000)) if 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b]))


def test_brute_force_in_units_of_few_sets(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "UNIT_SETS", 50)
    docs = corpus(2)
    assert sorted(tuple(r) for r in near_dups.find(spark.createDataFrame(docs, "doc_id long, text string"), **CONTRACT).collect()) == brute(docs)
