import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from namesake.llm import quality, toxicity
from namesake.llm.linear import Rows, fit, labelled_ids


def toxic_fixture(n=400, seed=1):
    rng = random.Random(seed)
    neutral = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(neutral) for _ in range(rng.randint(5, 40))]
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "Moronic"]))
        if rng.random() < (0.9 if bad else 0.1):
            words.append("muslim")  # goes along with the label in the sample
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_fit_matches_plain_gradient_descent():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (60, 5)).astype(float)
    y = (x[:, 0] + rng.random(60) > 0.9).astype(float)
    w, b = fit(Rows([np.flatnonzero(r) for r in x], 5), y, l2=0.1, steps=2000)
    v, c = np.zeros(5), 0.0
    for _ in range(20000):
        e = 1 / (1 + np.exp(-(x @ v + c))) - y
        v, c = v - 0.1 * (x.T @ e / 60 + 0.1 * v), c - 0.1 * e.mean()
    assert np.allclose(w, v, atol=1e-3) and abs(b - c) < 1e-3


def test_toxicity(spark):
    docs, labels = toxic_fixture()
    docs += [(1000, None), (1001, ""), (None, "idiotic"), (1002, "wortaa " * 30000 + "moronic"), (1003, "a b"), (1003, "a b")]
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, label string")
    marks = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame, marks, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [i for i in range(0, 400, 5)]
    assert np.mean([by_id[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert by_id[1002].predicted == 1 and by_id[1000].score == by_id[1001].score
    assert toxicity.score(frame.limit(0), marks, F.lit(True)).count() == 0
    assert {r.score for r in toxicity.score(frame, marks.limit(0), F.lit(True)).collect()} == {0.5}


def test_swapping_identity_terms_lowers_their_effect(spark):
    docs, labels = toxic_fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ids, counts = labelled_ids(marks, "toxic", F.lit(True), 500)
    rows = toxicity.sample_features(frame, ids)
    plain, held = (toxicity.train(rows, counts, swap_weight=w).scorer() for w in (0.0, 20.0))
    rise = lambda s: np.diff(s(["wortaa wortab", "wortaa wortab muslim"]))[0]
    assert rise(held) < 0.3 * rise(plain)
    assert held(["wortaa idiotic"])[0] > 0.5


def test_word_features():
    words = ["a", "abc", "abcd", "abcdefghijk", "xbcd", "é" * 5000, "abcdzz"]
    rows = toxicity.word_features(words)
    assert np.array_equal(rows, np.concatenate([toxicity.word_features([w]) for w in words]))
    assert [(r >= 0).sum() for r in rows] == [2, 2, 3, 8, 3, 8, 5]
    assert rows[2, 1] == rows[3, 1] == rows[6, 1] and rows[3, 2] == rows[6, 2] != rows[4, 2] and rows[2, 7] != rows[4, 7]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed)


def test_quality(spark):
    rng = random.Random(7)
    good = [f"good{i}" for i in range(60)] + ["été", "a b"]
    docs, labels = [], []
    for i in range(300):
        words = [rng.choice(good) for _ in range(rng.randint(10, 60))]
        bad = i % 3 == 0
        docs.append((i, "\n".join(w + "###" if bad else w for w in words) if i % 2 else " ".join(w + "|<" if bad else w for w in words)))
        labels.append((i, int(not bad), 0))
    docs += [(500, None), (501, ""), (502, "a b c d e f g h i j a b c d e"), (503, "x\n\nx\n x\nx\x0bx\r\n" * 9), (504, "漢 字 字 é " * 3), (None, "one two"), (505, "lang wort " * 40000), (502, "a b c d e f g h i j a b c d e")]
    docs += [(600 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 50)))) for i in range(40)]
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, kept string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score(frame, marks).collect()
    want = sorted(((i, *brute(t)) for i, t in docs), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    by_id = {r.doc_id: r for r in got}
    assert np.mean([by_id[i].kept == (i % 3 != 0) for i in range(300) if not by_id[i].base_failed]) > 0.97
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.score(frame.limit(0), marks).count() == 0
    assert all(r.kept != r.base_failed for r in quality.score(frame, marks.limit(0)).collect())


def test_pairs_of_words_and_characters_count():
    """Word order and letters beyond ASCII reach the quality model's features; pairs don't run over texts."""
    table = quality.WordHash()
    one, _, _ = quality.hashed_words([b"a b c".split()], table)
    two, _, _ = quality.hashed_words([b"a c b".split()], table)
    assert set(quality.word_buckets(one)) == set(quality.word_buckets(two)) and set(quality.pair_buckets(one)) != set(quality.pair_buckets(two))
    assert len(quality.trigrams("äöü")) == 1 and quality.trigrams("äöü") != quality.trigrams("äöß") and len(quality.trigrams("ab")) == len(quality.trigrams(None)) == 0


def test_very_long_words_count_to_their_ends():
    a, b = "x" * 9000 + "y", "x" * 9000 + "z"
    assert (toxicity.word_features([a])[0, 0] != toxicity.word_features([b])[0, 0]) and (toxicity.word_features([a])[0, 1:7] == toxicity.word_features([b])[0, 1:7]).all()
