"""Quality rules: counts of words and symbols, and a calibrated classifier of hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .linear import Rows, fit, labelled_ids, platt, sigmoid

#: White space that parts words, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BITS = 16
PER_CLASS = 2000
WINDOW = 5
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


class WordHash(dict):
    """64-bit hashes of words, kept as long as they are few."""

    limit = 1_000_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def repeated_words(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text, the words in windows of WINDOW words that the text has twice or more, all occurrences counted.

    hashes: of the words of all texts, one after the other; starts and sizes: where each text's are.
    """
    out = np.zeros(len(starts), np.int64)
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return out
    text = np.repeat(np.arange(len(starts)), sizes)
    with np.errstate(over="ignore"):
        windows = text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(WINDOW):
            windows += hashes[k : n + k] * _POWERS[k]
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    order = inside[np.argsort(windows[inside], kind="stable")]
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, order[twice], 1)
    np.add.at(edges, order[twice] + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(text[covered], minlength=len(starts)).astype(np.int64)


def base_counts(texts: list[str | None], words: list[list[bytes]], repeats: np.ndarray) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for text, w, r in zip(texts, words, repeats.tolist()):
        text = text or ""
        out["n_words"].append(len(w))
        out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(r)
    return out


def split_words(texts: list[str | None]) -> tuple[list[bytes], list[list[bytes]]]:
    raw = [(t or "").encode() for t in texts]
    return raw, [x.split() for x in raw]


def hashed_words(words: list[list[bytes]], table: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words])
    get = table.__getitem__
    hashes = np.fromiter((h for w in words for h in map(get, w)), np.uint64, int(sizes.sum()))
    return hashes, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


def trigrams(text: str | None) -> np.ndarray:
    """Hashed 3-grams of the text's characters."""
    c = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
    if len(c) < 3:
        return np.zeros(0, np.uint32)
    return ((c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.uint32)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Of each word but the last, the bucket of it and the next."""
    return word_buckets((hashes[:-1] * _POWERS[1] + hashes[1:]) * _POWERS[0])


@dataclass
class Model:
    """Weights of buckets of words, of characters and of pairs of words, for relative frequencies; margin = a * (means + b)
    + c is calibrated."""

    words: np.ndarray
    chars: np.ndarray
    pairs: np.ndarray
    intercept: float
    slope: float
    shift: float

    def probability(self, means: float) -> float:
        return float(sigmoid(self.slope * (means + self.intercept) + self.shift))


def sample_features(docs: DataFrame, ids: DataFrame) -> list:
    """(doc_id, label, indices, values): relative frequencies of word and character buckets of the sampled texts."""
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def make():
        table = WordHash()

        def work(part):
            _, words = split_words(part["text"])
            index, value = [], []
            for t, w in zip(part["text"], words):
                hashes, _, _ = hashed_words([w], table)
                found = [np.unique(x, return_counts=True) for x in (word_buckets(hashes), trigrams(t) + np.uint32(1 << BITS), pair_buckets(hashes) + np.uint32(2 << BITS))]
                index.append(np.concatenate([i for i, _ in found]).astype(np.int32).tobytes())
                value.append(np.concatenate([n / max(1, n.sum()) for _, n in found]).astype(np.float32).tobytes())
            return {"doc_id": part["doc_id"], "label": part["label"], "indices": index, "values": value}

        return work

    got = map_texts(rows, make, "doc_id long, label int, indices binary, values binary", ("doc_id", "text", "label"))
    return sorted(got.collect(), key=lambda r: (r.doc_id, bytes(r.indices)))  # bounded by the sample


def train(rows: list, counts: dict[int, int], l2: float = 1e-3) -> Model:
    """Fit on four fifths of the sample, calibrate on the rest, then move to the labels' true shares.

    Frequencies are divided by the root of their mean, so that rare n-grams count too. Without rows of both labels
    every text is as likely good as the labels are.
    """
    total = sum(counts.values())
    share = (counts.get(1, 0) + 0.5) / (total + 1)
    y = np.array([r.label for r in rows], float)
    width = 3 << BITS
    if len(rows) < 10 or y.min() == y.max():
        return Model(*np.zeros((3, 1 << BITS)), 0.0, 1.0, float(np.log(share / (1 - share))))
    index = [np.frombuffer(bytes(r.indices), np.int32) for r in rows]
    value = [np.frombuffer(bytes(r["values"]), np.float32).astype(float) for r in rows]
    mean = np.bincount(np.concatenate(index), np.concatenate(value), width) / len(rows)
    scale = 1 / np.sqrt(mean + 1e-5)
    value = [v * scale[i] for i, v in zip(index, value)]
    aside = np.arange(len(rows)) % 5 == 4
    pick = lambda xs, m: [x for x, k in zip(xs, m) if k]
    w, b = fit(Rows(pick(index, ~aside), width, pick(value, ~aside)), y[~aside], l2=l2, steps=150)
    rest = Rows(pick(index, aside), width, pick(value, aside))
    slope, shift = platt(rest.dot(w) + b, y[aside])
    shift += np.log(share / (1 - share)) - np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    w = w * scale
    return Model(*w.reshape(3, -1), b, slope, float(shift))


def score(docs: DataFrame, labels: DataFrame, keep: Column | None = None, column: str = "quality", least: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept.

    Base rules reject texts under 10 words and those of whose words over a fifth are in repeated windows; of the others
    the classifier keeps those whose probability of good quality is `least` or more. A null text has no words. Rows
    may repeat; an empty table gives no rows; very long texts are read whole; columns other than doc_id and text aren't
    read. Without ten labelled texts of both kinds a text is as likely good as the labels are; without labels all are kept.
    """
    ids, counts = labelled_ids(labels, column, F.lit(True) if keep is None else keep, per_class)
    model = train(sample_features(docs, ids), counts)

    def make():
        table = WordHash()

        def work(rows):
            _, words = split_words(rows["text"])
            hashes, starts, sizes = hashed_words(words, table)
            out = base_counts(rows["text"], words, repeated_words(hashes, starts, sizes))
            text = np.repeat(np.arange(len(sizes)), sizes)
            word = np.bincount(text, model.words[word_buckets(hashes)], len(sizes)) / np.maximum(1, sizes)
            inside = np.flatnonzero(text[1:] == text[:-1])
            pair = np.bincount(text[inside], model.pairs[pair_buckets(hashes)[inside]], len(sizes)) / np.maximum(1, sizes - 1)
            char = [float(model.chars[g].mean()) if len(g := trigrams(t)) else 0.0 for t in rows["text"]]
            failed = [n < 10 or 100 * r > 20 * n for n, r in zip(out["n_words"], out["n_repeat_words"])]
            good = [model.probability(a + b) for a, b in zip((word + pair).tolist(), char)]
            return out | {"doc_id": rows["doc_id"], "base_failed": failed, "quality": good, "kept": [not f and g >= least for f, g in zip(failed, good)]}

        return work

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    return map_texts(docs, make, kinds)
