"""Toxicity by a sparse logistic regression that is held to equal scores when identity terms are swapped."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .near_dups import mix
from .linear import Rows, fit, labelled_ids, sigmoid

WORD = re.compile(r"[^\W\d_]+")
BITS = 20
#: Bound of the labelled sample, for each label.
PER_CLASS = 2000
#: Features that are fitted: those whose shares of the two labels differ most for their spread.
FEATURES = 5000
#: Words for groups of people, by kind. Swapping one for another of its kind shouldn't change a score.
IDENTITY_TERMS = (
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "disabled", "blind", "deaf"),
)
SWAP = {a: b for kind in IDENTITY_TERMS for a, b in zip(kind, kind[1:] + kind[:1])}


_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
#: L1 weights that training chooses from, by the log loss on a fifth of its own sample.
L1 = (3e-4, 1e-3, 3e-3)


def word_features(words: list[str]) -> np.ndarray:
    """Hashed features of lower-case words, a row each: the word, its beginnings of 3 to 8 letters if it is longer, and
    its last 4 letters. -1 where there is none. Hashes are sums of code points times powers, so that all beginnings come
    from one running sum; powers come again after 4,096 letters."""
    if not words:
        return np.zeros((0, 8), np.int32)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    start = end - size
    place = np.arange(len(codes)) - np.repeat(start, size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * _POWERS[place % len(_POWERS)])])
    values = [sums[end] - sums[start]]
    there = [np.ones(len(words), bool)]
    for k in range(3, 9):
        there.append(size > k)
        values.append(sums[np.minimum(start + k, end)] - sums[start])
    last = np.zeros(len(words), np.uint64)
    for j in range(1, 5):
        last += np.where(size >= j, codes[np.maximum(end - j, start)], 0).astype(np.uint64) * _POWERS[j]
    values.append(last)
    there.append(np.ones(len(words), bool))
    salt = np.arange(1, 9, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    found = (mix(np.stack(values) + salt) >> np.uint64(64 - BITS)).astype(np.int32)
    return np.where(np.stack(there), found, -1).T


def text_features(words: set[str]) -> np.ndarray:
    found = np.unique(word_features(sorted(words)))
    return found[found >= 0].astype(np.int32)


@dataclass
class Model:
    """Weights of the features that have any, and the intercept."""

    weights: dict[int, float]
    intercept: float

    def scorer(self):
        """A function of texts; it keeps which words have a feature that counts."""
        cache: dict[str, tuple[int, ...]] = {}
        weights = self.weights
        counts = np.zeros(1 << BITS, bool)
        counts[list(weights)] = True

        def score(texts: list[str | None]) -> list[float]:
            split = [set(WORD.findall((t or "").lower())) for t in texts]
            if len(cache) > 1_000_000:
                cache.clear()
            new = list(set().union(*split) - cache.keys())
            cache.update(dict.fromkeys(new, ()))
            features = word_features(new)
            active = counts[features] & (features >= 0)
            for k in np.flatnonzero(active.any(1)):
                cache[new[k]] = tuple(features[k, active[k]].tolist())
            out = []
            for words in split:
                found = {f for got in map(cache.__getitem__, words) if got for f in got}
                out.append(float(sigmoid(self.intercept + sum(weights[f] for f in sorted(found)))))
            return out

        return score


def sample_features(docs: DataFrame, ids: DataFrame) -> list:
    """(doc_id, label, features, swapped) of the sampled texts; swapped: with identity terms exchanged, if there are any."""
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def make():
        def work(part):
            plain, swapped = [], []
            for text in part["text"]:
                words = set(WORD.findall((text or "").lower()))
                plain.append(text_features(words).tobytes())
                other = {SWAP.get(w, w) for w in words}
                swapped.append(text_features(other).tobytes() if words & SWAP.keys() else None)
            return {"doc_id": part["doc_id"], "label": part["label"], "plain": plain, "swapped": swapped}

        return work

    got = map_texts(rows, make, "doc_id long, label int, plain binary, swapped binary", ("doc_id", "text", "label"))
    return sorted(got.collect(), key=lambda r: (r.doc_id, bytes(r.plain)))  # bounded by the sample


def select(plain: list[np.ndarray], y: np.ndarray, least: int) -> np.ndarray:
    """The FEATURES that tell the labels apart best by a test of two shares, of those that `least` texts have."""
    of = [np.bincount(np.concatenate([x for x, k in zip(plain, y) if k == v]), minlength=1 << BITS) for v in (0, 1)]
    n = [(y == v).sum() for v in (0, 1)]
    pooled = (of[0] + of[1] + 1) / (len(y) + 2)
    z = np.abs(of[1] / n[1] - of[0] / n[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    z[of[0] + of[1] < least] = -1
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(best[z[best] >= 0])


def log_loss(model: Model, rows: list) -> float:
    """The mean log loss of sampled rows."""
    z = np.array([model.intercept + sum(model.weights.get(f, 0.0) for f in np.frombuffer(bytes(r.plain), np.int32).tolist()) for r in rows])
    y = np.array([r.label for r in rows])
    return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean())


def choose(rows: list, swap_weight: float = 1.0, least: int = 5) -> float:
    """The L1 weight whose model of four fifths of the sample has the lowest log loss on the rest. The smallest sample: the middle one."""
    fit_rows, rest = [r for k, r in enumerate(rows) if k % 5 != 4], rows[4::5]
    if len({r.label for r in fit_rows}) < 2 or not rest:
        return L1[1]
    share = {v: sum(r.label == v for r in fit_rows) for v in (0, 1)}
    return min(L1, key=lambda l1: log_loss(train(fit_rows, share, l1, swap_weight, least), rest))


def train(rows: list, counts: dict[int, int], l1: float | None = None, swap_weight: float = 1.0, least: int = 5) -> Model:
    """Fit on features that `least` sampled texts have; the intercept is moved to the labels' true shares.

    Without l1, it is the best of L1 on a part of the rows. Without rows of both labels the score is the smoothed share of
    label 1.
    """
    l1 = choose(rows, swap_weight, least) if l1 is None else l1
    total = sum(counts.values())
    share = (counts.get(1, 0) + 0.5) / (total + 1)
    y = np.array([r.label for r in rows], float)
    if not rows or y.min() == y.max():
        return Model({}, float(np.log(share / (1 - share))))
    plain = [np.frombuffer(bytes(r.plain), np.int32) for r in rows]
    often = select(plain, y, least)
    place = np.full(1 << BITS, -1, np.int32)
    place[often] = np.arange(len(often))
    known = lambda x: place[x][place[x] >= 0]
    left, sign = [], []
    for r, x in zip(rows, plain):
        if r.swapped is not None:
            a, b = known(x), known(np.frombuffer(bytes(r.swapped), np.int32))
            out, new = np.setdiff1d(a, b), np.setdiff1d(b, a)
            left.append(np.concatenate([out, new]))
            sign.append(np.concatenate([-np.ones(len(out)), np.ones(len(new))]))
    pairs = Rows(left, len(often), sign) if left else None
    w, b = fit(Rows([known(x) for x in plain], len(often)), y, l1=l1, pairs=pairs, weight=swap_weight)
    b += np.log(share / (1 - share)) - np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return Model({int(often[i]): float(w[i]) for i in np.flatnonzero(w)}, float(b))


def score(docs: DataFrame, labels: DataFrame, keep: Column, column: str = "toxic", threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of every whole text.

    keep says which labelled ids may be learned from. A null text is an empty one and gets the intercept's score. Rows
    may repeat, equal texts have equal scores, and a score of just the threshold is predicted 1. Very long texts are read
    whole; columns other than doc_id and text aren't read; without labels all scores are 0.5.
    """
    ids, counts = labelled_ids(labels, column, keep, per_class)
    model = train(sample_features(docs, ids), counts)

    def make():
        one = model.scorer()

        def work(rows):
            scores = one(rows["text"])
            return {"doc_id": rows["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return work

    return map_texts(docs, make, "doc_id long, score double, predicted int")
