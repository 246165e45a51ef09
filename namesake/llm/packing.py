"""Packing of tokenized documents into sequences by linear grouping, then best fit."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, number_within, salts_for

TOKENIZER = "word_bpe_49k.json"
CACHE = 300_000
#: Chunks of more characters are encoded each time they come.
LONGEST = 64
#: An ASCII mark behind a letter or a number and before white space: the tokenizer takes it by itself.
MARK = re.compile(r"[.,;:!?](?<=[^\W_].)(?=[ \n\r\t]|\Z)")
#: str.split() parts at these too, the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
CHUNK = re.compile(rf"(?:\S|[{SEPARATORS}])+")


def chunks_of(text: str) -> list[str]:
    """Chunks of the text that can be encoded apart: parted at the tokenizer's white space and before single marks."""
    text = MARK.sub(r" \g<0>", text.lower() if text.isascii() else text)
    return CHUNK.findall(text) if any(c in text for c in SEPARATORS) else text.split()


class Chunks(dict):
    """Places of chunks among the encoder's entries; a new chunk gets a number below 0 and is noted in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = place = -len(self.new)
        return place


class Encoder:
    """Token ids of texts by the tokenizer's file, with the ids of chunks between white space kept as entries of one array.

    Chunks of over LONGEST characters aren't kept, and all is forgotten when there are `limit` chunks or ten times as
    many ids.
    """

    def __init__(self, path: str, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.chunks = Chunks()
        self.flat, self.start, self.length = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Add entries; their places."""
        first = len(self.length)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, ids.astype("<u4")])
        return np.arange(first, len(self.length))

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after the other, and how many each has."""
        lengths = self.length[places]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[places] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))], lengths

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Places of new chunks. Those of letters, of which each ends in one word-end token, go many in a call."""
        low = [c.lower() if c.isascii() and c.isalpha() else c for c in chunks]
        known = self.chunks
        places = {c: k for c in low if (k := known.get(c, -1)) >= 0}
        new = sorted(set(low) - places.keys())
        plain = [c for c in new if c.isalpha()]
        other = [c for c in new if not c.isalpha()]
        done, ids, lengths = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(plain), 1000):
            group = plain[i : i + 1000]
            found = np.array(self.many([" ".join(group)], add_special_tokens=False)[0].ids)
            at = np.flatnonzero(self.ends[found]) + 1
            if len(at) != len(group):  # a script in which letters don't make one word
                other += group
                continue
            done += group
            ids.append(found)
            lengths.append(np.diff(at, prepend=0))
        for i in range(0, len(other), 1000):
            group = other[i : i + 1000]
            found = [e.ids for e in self.many(group, add_special_tokens=False)]
            done += group
            ids.append(np.array([x for f in found for x in f], np.int64))
            lengths.append(np.array([len(f) for f in found]))
        places.update(zip(done, self._append(np.concatenate(ids), np.concatenate(lengths)).tolist()))
        return np.fromiter(map(places.__getitem__, low), np.int64, len(low))

    def encode(self, texts: list[str | None], tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the id `tail` behind if there is one, and how many each text has."""
        table = self.chunks
        split = [chunks_of(t or "") for t in texts]
        size = np.array([len(x) for x in split], np.int64)
        places = np.fromiter(chain.from_iterable(map(table.__getitem__, x) for x in split), np.int64, int(size.sum()))
        if table.new:
            learned = self._learn(table.new)
            new = places < 0
            places[new] = learned[-1 - places[new]]
            table.update(zip(table.new, learned.tolist()))
            for c in table.new:
                if len(c) > LONGEST:
                    del table[c]
            table.new = []
        if tail is not None:
            end = self._append(np.array([tail]), np.array([1]))
            places, size = np.insert(places, np.cumsum(size), end), size + 1
        ids, lengths = self._gather(places)
        before = np.concatenate([[0], np.cumsum(lengths)])
        edges = before[np.concatenate([[0], np.cumsum(size)])]
        if len(table) > self.limit or len(self.flat) > 10 * self.limit:
            self._forget()
        return ids, np.diff(edges)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, so that what a task has learned serves the next."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut where longer than the capacity."""

    def make():
        def work(rows):
            ids, lengths = encoder(path).encode(rows["text"], end_id)
            raw, at = memoryview(ids.tobytes()), 0
            out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, n in zip(rows["doc_id"], lengths.tolist()):
                for k, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    for column, v in zip(out.values(), (doc_id, k, start, size, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + size)]))):
                        column.append(v)
                at += n
            return out

        return work

    return map_texts(docs, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fill(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size, at most `left` of it, to take for the fullest sum up to room (bounded knapsack)."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    steps = []
    for g, size in enumerate(sizes):
        k, rest = 1, min(left[g], room // size)
        while rest > 0:
            k = min(k, rest)
            before = reach.copy()
            reach[k * size :] |= before[: room + 1 - k * size]
            steps.append((g, k, before))
            rest, k = rest - k, 2 * k
    total = int(np.flatnonzero(reach)[-1])
    take = [0] * len(sizes)
    for g, k, before in reversed(steps):
        if not before[total]:
            take[g] += k
            total -= k * sizes[g]
    return take


def plan(histogram: dict[int, int], capacity: int = 4096, groups: int = 64, small: int = 8) -> tuple[list[tuple[int, int, int, int]], int]:
    """Where the pieces of each length go: (length, first rank, one past the last rank, bin of the first), and the number of bins.

    Pieces over capacity / small are large. Sorted by length they fall into groups of equal number; each counts as its
    group's largest, and configurations of group sizes are made one after the other: the largest size left, filled
    up as far as possible, used as often as its sizes last. Then the pieces themselves take the places, which
    leaves runs of bins with equal room, and small ones go, longest first, where they leave the least room.
    Everything works on counts of lengths, so that its cost depends on the capacity and not on the documents.
    """
    lengths = sorted((n for n in histogram if histogram[n] > 0), reverse=True)
    large = [n for n in lengths if n * small > capacity]
    total = sum(histogram[n] for n in large)
    used = defaultdict(int)  # pieces of a length that have a place
    moves: list[tuple[int, int, int, int]] = []
    members: list[list[list[int]]] = []  # of a group: [length, number]
    share, have = max(1, -(-total // groups)), 0
    for n in large:
        rest = histogram[n]
        while rest:
            if not have:
                members.append([])
                have = share
            k = min(rest, have)
            members[-1].append([n, k])
            rest, have = rest - k, have - k
    sizes = [m[0][0] for m in members]
    left = [sum(k for _, k in m) for m in members]
    bins = 0
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    while any(left):
        first = next(g for g, k in enumerate(left) if k)
        take = fill(sizes, [k - (g == first) for g, k in enumerate(left)], capacity - sizes[first])
        take[first] += 1
        times = min(left[g] // t for g, t in enumerate(take) if t)
        cuts, room = [0, times], np.zeros(0)
        slots = []
        for g, t in enumerate(take):
            for _ in range(t):
                at, slot, need = 0, [], times
                while need:
                    n, k = members[g][0]
                    m = min(k, need)
                    slot.append((at, at + m, n))
                    members[g][0][1] -= m
                    if not members[g][0][1]:
                        members[g].pop(0)
                    at, need = at + m, need - m
                slots.append(slot)
                cuts += [a for a, _, _ in slot]
            left[g] -= t * times
        cuts = sorted(set(cuts))
        room = np.full(len(cuts) - 1, capacity)
        for slot in slots:
            for a, b, n in slot:
                room[bisect.bisect_left(cuts, a) : bisect.bisect_left(cuts, b)] -= n
                moves.append((n, used[n], used[n] + b - a, bins + a))
                used[n] += b - a
        for a, b, r in zip(cuts, cuts[1:], room.tolist()):
            rooms[r].append((bins + a, bins + b))
        bins += times
    for n in (x for x in lengths if x * small <= capacity):
        rest = histogram[n]
        levels = sorted(r for r in rooms if rooms[r] and r >= n)
        while rest:
            while levels and not rooms[levels[0]]:
                levels.pop(0)
            if levels:
                room = levels[0]
                a, b = rooms[room].pop()
            else:
                room, a, b = capacity, bins, bins + -(-rest // (capacity // n))
                bins = b
            m = min(rest, b - a)
            moves.append((n, used[n], used[n] + m, a))
            used[n] += m
            rest -= m
            rooms[room - n].append((a, a + m))
            if room - n >= n:
                bisect.insort(levels, room - n)
            if a + m < b:
                rooms[room].append((a + m, b))
                if not levels or levels[0] != room:
                    bisect.insort(levels, room)
    return moves, bins


def pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents; one row per piece: its document, place there, crc32 of ids, sequence_id and offset.

    A null or empty text is the end id alone. Rows may repeat, each is packed. A text of more than capacity ids, however long, is
    cut into pieces of capacity, the last one shorter; equal lengths are interchangeable, by hash and then by id. Other
    columns, of any name, aren't read. An empty table gives no rows. The driver sees the counts of the lengths 1 to capacity;
    the plan made of them has a bounded number of rows too and is broadcast.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    cut = materialize(pieces(docs, path, capacity, end_id))
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts_for(cut.count())))
    cut = cut.withColumn("_salt", salt)
    counts = cut.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    moves, _ = plan(histogram, capacity)
    places = spark.createDataFrame(moves, "length long, low long, high long, bin long")
    ranked = number_within(cut, counts, "length", "_salt", ["doc_id", "piece", "ids_crc32"], "rank")
    placed = ranked.join(F.broadcast(places), "length").filter("rank >= low and rank < high")
    placed = placed.withColumn("sequence_id", F.col("bin") + F.col("rank") - F.col("low"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
