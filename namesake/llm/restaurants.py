"""Numpy parts of the Pitman-Yor model: compact arrays, the layout of a chunk's word pairs, and the Gibbs sampler."""

from __future__ import annotations

import random

import numpy as np
import zstandard

from .near_dups import mix

#: Keys of words: places in the dictionary of common words, or this bit and 63 bits of the word's hash.
RARE = np.uint64(1 << 63)
#: So many of the largest dishes are seated one after the other, the rest side by side.
ALONE = 48


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; whole numbers from 0 on take the narrowest type, bytes of equal place go together."""
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind in "iub" and a.dtype != np.uint64:
            top = int(a.max(initial=0))
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
        head += [ord(a.dtype.char), len(a)]
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpack(raw: bytes) -> list[np.ndarray]:
    """The arrays of pack(); whole numbers as 64-bit ones."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for code, size in zip(head[::2].tolist(), head[1::2].tolist()):
        kind = np.dtype(chr(code))
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out.append(a.astype(np.int64) if kind.kind in "iu" and kind != np.uint64 else a)
        at += size * kind.itemsize
    return out


def key_arrays(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted keys as two arrays: steps between the common ones, and the rare ones."""
    cut = int(np.searchsorted(keys, RARE))
    return [np.diff(keys[:cut].astype(np.int64), prepend=0), keys[cut:].astype(np.uint64)]


def keys_from(steps: np.ndarray, rare: np.ndarray) -> np.ndarray:
    return np.concatenate([np.cumsum(steps).astype(np.uint64), rare])


def homes(keys: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of each word's restaurant; -1 for hot words, whose restaurants are spread over the parts."""
    home = (mix(keys ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(parts)).astype(np.int64)
    home[np.isin(keys, hot)] = -1
    return home


class Layout:
    """The pairs (context, word) of a chunk, sorted by part, context and word, and each token's pair.

    keys: the chunk's words, sorted; place: of each token; the context of a document's first token is the end.
    """

    def __init__(self, keys, place, sizes, end: int, hot: np.ndarray, parts: int):
        before = np.empty_like(place)
        before[1:] = place[:-1]
        before[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)] = end
        pairs, inverse = np.unique(before * len(keys) + place, return_inverse=True)
        context, word = pairs // len(keys), pairs % len(keys)
        self.home = homes(keys, hot, parts)
        part = self.home[context]
        spread = np.flatnonzero(part < 0)
        part[spread] = (mix(keys[context[spread]] * np.uint64(0xE7037ED1A0B428DB) + keys[word[spread]]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        self.context, self.word, self.part = context[order], word[order], part[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[inverse]

    def parts(self):
        """(part, first pair, one past the last) of each part that has pairs."""
        found, first = np.unique(self.part, return_index=True)
        return zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(self.part)])


def discount_of(ones: float, twos: float) -> float:
    """The usual estimate from the numbers of dishes with one and two customers."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos > 0 else 0.5


class Seating:
    """Seats of dishes with two customers or more, reseated by Gibbs sampling.

    c: customers of each dish; group: its restaurant; prob: the parent's probability of it; tables: of each
    restaurant, tables of all its dishes here (kept up to date); scale: by how much more the whole restaurant has.
    A new table weighs (strength + discount * tables * scale) * prob, one of n customers weighs n - discount.
    """

    def __init__(self, c, group, prob, tables, scale, strength: float, discount: float, seed: int):
        self.order = np.argsort(-c, kind="stable")
        self.n, self.group, self.prob = c[self.order], group[self.order], prob[self.order]
        self.tables, self.scale, self.strength, self.d = tables, scale, strength, discount
        self.rng, self.dice = np.random.default_rng(seed), random.Random(seed)
        self.start = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64)
        total = int(self.n.sum())
        self.seat, self.size = np.zeros(total, np.int32), np.zeros(total, np.int32)
        self.size[self.start] = 1
        self.t = np.ones(len(c), np.int64)
        self.alone = min(ALONE, len(c))
        self._pass(True)

    def sweep(self) -> None:
        """Every customer of every dish gets up and sits down anew, given all others."""
        self._pass(False)

    def counts(self) -> np.ndarray:
        """Tables of each dish."""
        out = np.empty(len(self.n), np.int64)
        out[self.order] = self.t
        return out

    def _pass(self, first: bool) -> None:
        for k in range(self.alone):
            self._one(k, first)
        a = self.alone
        if a < len(self.n):
            longest = int(self.n[a])
            ends = np.searchsorted(-self.n, -np.arange(longest + 1), side="left")  # of i: dishes of more than i customers
            for i in range(int(first), longest):
                self._step(a, int(ends[i]), i, first)

    def _one(self, k: int, first: bool) -> None:
        """A pass over the customers of one dish."""
        n, at, d, g = int(self.n[k]), int(self.start[k]), self.d, int(self.group[k])
        seat, size = self.seat[at : at + n].tolist(), self.size[at : at + n].tolist()
        t, whole, parent, scale, strength = int(self.t[k]), int(self.tables[g]), float(self.prob[k]), float(self.scale[g]), self.strength
        roll, free = self.dice.random, [j for j in range(n - 1, -1, -1) if not size[j]]
        for i in range(int(first), n):
            others = i if first else n - 1
            if not first:
                j = seat[i]
                size[j] -= 1
                if not size[j]:
                    free.append(j)
                    t -= 1
                    whole -= 1
            new = (strength + d * whole * scale) * parent
            if roll() * (new + others - d * t) < new:
                j = free.pop()
                t += 1
                whole += 1
            else:
                while True:
                    other = int(roll() * others)
                    j = seat[other if first or other < i else other + 1]
                    if roll() * size[j] < size[j] - d:
                        break
            seat[i] = j
            size[j] += 1
        self.seat[at : at + n], self.size[at : at + n] = seat, size
        self.t[k], self.tables[g] = t, whole

    def _step(self, a: int, b: int, i: int, first: bool) -> None:
        """Customer i of each of the dishes a to b - 1 gets up, unless it is new, and sits down. Those of one restaurant
        who move in the same step see the others' tables as they were before it."""
        start, group, rng, d = self.start[a:b], self.group[a:b], self.rng, self.d
        others = i if first else self.n[a:b] - 1
        t = self.t[a:b]
        whole = self.tables[group]
        if not first:
            place = start + self.seat[start + i]
            self.size[place] -= 1
            gone = np.flatnonzero(self.size[place] == 0)
            t[gone] -= 1
            whole[gone] -= 1
            np.subtract.at(self.tables, group[gone], 1)
        new = (self.strength + d * whole * self.scale[group]) * self.prob[a:b]
        fresh = rng.random(b - a) * (new + others - d * t) < new
        rest = np.flatnonzero(~fresh)
        while len(rest):
            span = i if first else others[rest]
            other = (rng.random(len(rest)) * span).astype(np.int64)
            if not first:
                other += other >= i
            table = self.seat[start[rest] + other]
            n = self.size[start[rest] + table]
            good = rng.random(len(rest)) * n < n - d
            fit = rest[good]
            self.seat[start[fit] + i] = table[good]
            self.size[start[fit] + table[good]] += 1
            rest = rest[~good]
        fresh = np.flatnonzero(fresh)
        label = np.full(len(fresh), i)
        while (used := self.size[start[fresh] + label] > 0).any():
            label[used] = (label[used] + 1) % self.n[a:b][fresh[used]]
        self.seat[start[fresh] + i] = label
        self.size[start[fresh] + label] = 1
        t[fresh] += 1
        np.add.at(self.tables, group[fresh], 1)


def seat_parent(c: np.ndarray, base: float, scale: float, strength: float, discount: float, seed: int, sweeps: int = 1, rest: int = 0) -> np.ndarray:
    """Tables in the parent's restaurant of dishes of c customers. The restaurant has `rest` tables of other dishes, which stay,
    and scale times the tables of these; with a rest the scale is 1, so that only their own changes move the total."""
    t = np.minimum(c, 1)
    many = np.flatnonzero(c > 1)
    if len(many):
        seats = Seating(c[many], np.zeros(len(many), np.int64), np.full(len(many), base), np.array([t.sum() + rest]), np.array([scale]), strength, discount, seed)
        for _ in range(sweeps):
            seats.sweep()
        t[many] = seats.counts()
    return t
