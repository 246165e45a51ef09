import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesake.llm import pitman_yor as py
from namesake.llm import restaurants as r
from namesake.llm.common import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


def corpus(n=400):
    rng = random.Random(6)
    follow = {w: [rng.randrange(60) for _ in range(3)] for w in range(60)}
    docs = []
    for i in range(n):
        at, out = rng.randrange(60), []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(["the", f"W{at}", f"w{at}"]))
            at = rng.choice(follow[at])
        docs.append((i, " ".join(out)))
    return docs + [(1000, None), (1001, ""), (1002, "new words only"), (None, "the w1"), (3, "the the"), (1003, "the w2 " * 20_000)]


@pytest.mark.parametrize("tokens,dictionary", [(3_000_000, 1 << 20), (3000, 1 << 20), (700, 30)])
def test_scores(spark, monkeypatch, tokens, dictionary):
    """Base columns by brute force; in one part, and in many with hot words and with words that the dictionary leaves out."""
    monkeypatch.setattr(py, "CHUNK_TOKENS", tokens)
    monkeypatch.setattr(py, "PART_TOKENS", tokens)
    monkeypatch.setattr(py, "DICTIONARY", dictionary)
    docs = corpus()
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string")
    out = held_out(F.col("doc_id"), 7, 2)
    held = {x.doc_id: x.h for x in frame.select("doc_id", out.alias("h")).collect()}
    got = py.score(frame, out).collect()
    c = Counter(w for i, t in docs if not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held[i], len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in docs), key=str)
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got), key=str) == want
    assert all(x.score < 0 for x in got)
    some = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 1000]
    assert sum(x.score for x in some) > 0.9 * sum(x.base_score for x in some)  # the order of words helps: log10 is a tenth less


@pytest.mark.parametrize("tokens", [3_000_000, 1500])
def test_probabilities_sum_to_one(spark, monkeypatch, tokens):
    """Over all words and one unknown, in several contexts, from what the chunks get of all parts."""
    monkeypatch.setattr(py, "PART_TOKENS", tokens)
    docs = corpus(150)
    vocabulary = sorted({w for _, t in docs for w in words(t)[:-1]})
    probe = [(5000 + k, " ".join(f"{u} {w}" for w in [*vocabulary, "unknown"])) for k, u in enumerate(["the", "w3", "2"])]
    probe += [(6000 + k, u) for k, u in enumerate(["the", "w3", "2"])]  # the end after each context
    frame = spark.createDataFrame(docs + probe, "doc_id long, text string").coalesce(1)  # one chunk
    rows, model = py.learn(frame, F.coalesce(F.col("doc_id") >= 5000, F.lit(False)))
    assert (model["parts"] > 1 and len(model["hot"]) > 0) == (tokens == 1500)
    groups: dict = {}
    for x in rows.collect():
        groups.setdefault(x["at"], []).append((x["kind"], x["source"], bytes(x["data"])))
    done = 0
    for got in groups.values():
        chunk = py.Chunk(got, model)
        p = chunk.probabilities()[chunk.plan.pair]
        start = dict(zip(chunk.ids.tolist(), np.concatenate([[0], np.cumsum(chunk.sizes)[:-1]]).tolist()))
        for k in range(3):
            if 5000 + k in start and 6000 + k in start:
                a = start[5000 + k]
                assert abs(p[a + 1 : a + 2 * (len(vocabulary) + 1) : 2].sum() + p[start[6000 + k] + 1] - 1) < 1e-9
                done += 1
    assert done == 3


def test_tables_follow_the_exact_distribution():
    """Of three customers with one dish, against the weights of all five partitions; seated side by side and one by one."""
    d, w, many = 0.5, 0.8, 20_000
    weights = np.array([w * (1 - d) * (2 - d), 3 * w * w * (1 - d), w**3])
    for alone in (0, many):
        r.ALONE = alone
        seats = r.Seating(np.full(many, 3), np.arange(many), np.full(many, w), np.zeros(many, np.int64), np.zeros(many), 1.0, d, 0)
        for _ in range(4):
            seats.sweep()
        got = np.bincount(seats.counts(), minlength=4)[1:] / many
        assert np.allclose(got, weights / weights.sum(), atol=0.02)
    r.ALONE = 48


def test_tables_feed_back_into_the_restaurant():
    """Two dishes of two customers in one restaurant: a new table's weight follows the tables of both."""
    d, s, p, many = 0.5, 0.7, 0.4, 20_000
    for alone in (0, 2 * many):
        r.ALONE = alone
        tables = np.full(many, 2)
        seats = r.Seating(np.full(2 * many, 2), np.repeat(np.arange(many), 2), np.full(2 * many, p), tables, np.ones(many), s, d, 0)
        for _ in range(8):
            seats.sweep()
        t = seats.counts().reshape(-1, 2)
        assert (t.sum(1) == tables).all()
        rising = [1.0, 1.0, (s + d) * p, (s + d) * (s + 2 * d) * p, (s + d) * (s + 2 * d) * (s + 3 * d) * p]  # up to a factor
        weights = np.array([rising[2] * p * (1 - d) ** 2, 2 * rising[3] * p * p * (1 - d), rising[4] * p**3])
        got = np.bincount(t.sum(1), minlength=5)[2:] / many
        assert np.allclose(got, weights / weights.sum(), atol=0.02 if alone else 0.03)
    r.ALONE = 48


def test_hot_words_see_the_tables_of_all_others():
    """One dish of three customers in a restaurant with tables of other dishes that stay, against the exact distribution."""
    d, s, p, rest, many = 0.6, 10.0, 0.02, 40, 20_000
    new = lambda k: (s + d * (rest + k)) * p
    weights = np.array([new(0) * (1 - d) * (2 - d), 3 * new(0) * new(1) * (1 - d), new(0) * new(1) * new(2)])
    got = np.bincount([int(r.seat_parent(np.array([3]), p, 1.0, s, d, seed, 3, rest)[0]) for seed in range(many)], minlength=4)[1:] / many
    assert np.allclose(got, weights / weights.sum(), atol=0.015)


def test_hot_words_do_not_feed_on_their_own_tables():
    """With the total of a large vocabulary at hand, words of many customers get few tables."""
    t = r.seat_parent(np.full(20, 30_000), 1e-6, 1.0, 10.0, 0.6, 0, 1, 1_500_000)
    assert 5 < t.mean() < 20


@pytest.mark.parametrize("tokens", [3000])
def test_perplexity_in_many_parts(spark, monkeypatch, tokens):
    """Many parts with hot words score held-out texts within a hundredth of what one part does."""
    docs = corpus(600)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = held_out(F.col("doc_id"), 7, 2)
    total = lambda: sum(x.score for x in py.score(frame, out).collect() if x.held_out)
    one = total()
    monkeypatch.setattr(py, "PART_TOKENS", tokens)
    assert abs(total() / one - 1) < 0.01


def test_packing_of_arrays():
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 200, 50), np.zeros(0, np.int64), rng.integers(0, 1 << 40, 9), rng.integers(0, 1 << 63, 7).astype(np.uint64) * np.uint64(2), rng.random(5) > 0.5]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, r.unpack(r.pack(*arrays))))
    keys = np.unique(np.concatenate([rng.integers(0, 1000, 50).astype(np.uint64), rng.integers(0, 1 << 63, 20).astype(np.uint64) | r.RARE]))
    assert (r.keys_from(*r.unpack(r.pack(*r.key_arrays(keys)))) == keys).all()


def test_empty_and_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert py.score(frame.limit(0), F.lit(False)).count() == 0
    only = py.score(frame, F.lit(True)).first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score) == (3, 0, 0, 0.0) and abs(only.score) < 1e-9
