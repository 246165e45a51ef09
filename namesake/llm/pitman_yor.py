"""A hierarchical Pitman-Yor language model: a restaurant for every word before, over one shared parent, seated by Gibbs sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices
from .restaurants import RARE, Layout, Seating, discount_of, homes, key_arrays, keys_from, pack, seat_parent, unpack

#: Tokens of a chunk of documents and, about, of a part of the model; they bound what a task holds.
CHUNK_TOKENS = 1_000_000
CHUNK_DOCS = 60_000
PART_TOKENS = 2_000_000
#: Different words that a task counts before it passes them on.
COUNTED = 2_000_000
#: Bound of the dictionary that gives common words short names; other words go by their hashes.
DICTIONARY = 1 << 20
SAMPLES = 2
#: Full sweeps before the first sample, and before each sample.
BURN_IN, BETWEEN = 1, 1
STRENGTH, PARENT_STRENGTH = 1.0, 10.0
END = 0x5851F42D4C957F2D

ROWS = "kind byte, at long, source long, data binary, counts array<long>, hot array<long>"
SCHEMA = pa.schema([("kind", pa.int8()), ("at", pa.int64()), ("source", pa.int64()), ("data", pa.binary()), ("counts", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64()))])
#: Kinds of rows. To the part `at`: its pairs, the words it needs to know of from their homes, what they say, the tables
#: that it adds to them, the words of chunks at home there. To the chunk `at`: counts of its pairs and of its words.
PART, NEED, KNOWN, ADDED, ASKED, PAIRS, WORDS, TOTAL = range(8)


class WordHash(dict):
    """63-bit hashes of words; few are kept, as parts of the model need the memory."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) >> 1
        if len(self) < 200_000 and len(word) < 64:
            self[word] = value
        return value


def tokens_of(text: str | None, table: WordHash) -> np.ndarray:
    """Hashes of the words of the ASCII-lower-cased text and of its end."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, train flags, token counts, tokens) of about CHUNK_TOKENS tokens, one document at least."""
    table = WordHash()
    ids, train, parts, total = [], [], [], 0

    def close():
        return ids, np.array(train, bool), np.array([len(x) for x in parts]), np.concatenate(parts)

    for batch in slices(batches):
        rows = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for doc_id, text, held in zip(rows["doc_id"], rows["text"], rows["held"]):
            ids.append(doc_id)
            train.append(not held)
            parts.append(tokens_of(text, table))
            total += len(parts[-1])
            if total >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                yield close()
                ids, train, parts, total = [], [], [], 0
    if ids:
        yield close()


def cut_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, data): the documents' ids, flags and sizes, the words' hashes and numbers, and each token's word by its rank in the chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("data", pa.binary())])

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for number, (ids, train, sizes, tokens) in enumerate(chunks(batches)):
            words, place = np.unique(tokens, return_inverse=True)
            n = np.bincount(place, minlength=len(words))
            trained = np.bincount(place[np.repeat(train, sizes)], minlength=len(words))
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(words))
            known = np.array([i is not None for i in ids])
            data = pack(np.array([i or 0 for i in ids], np.int64).view(np.uint64), known, train, sizes, words, n, trained, rank[place])
            yield pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([data], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "chunk long, data binary")


def open_chunk(data: bytes, model: dict):
    """The chunk's documents, its words' sorted keys, each token's word, and the layout of its pairs."""
    ids, known, train, sizes, words, n, _, rank = unpack(data)
    place = np.argsort(-n, kind="stable")[rank]
    common = model["common"]
    at = np.minimum(np.searchsorted(common, words), max(0, len(common) - 1))
    keys = np.where(common[at] == words, at.astype(np.uint64), words | RARE) if len(common) else words | RARE
    order = np.argsort(keys)
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    end = int(where[np.searchsorted(words, np.uint64(END))])
    keys, place = keys[order], where[place]
    return ids.view(np.int64), known.astype(bool), train.astype(bool), sizes, keys, place, Layout(keys, place, sizes, end, model["hot"], model["parts"])


def count_words(chunked: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0: training tokens by their words' hashes; kind 1: all tokens, under the key 0."""
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def out(kind: int, keys: np.ndarray, n: np.ndarray):
        for at in range(0, len(keys), 100_000):
            k = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.astype(np.int64)), pa.array(n[at : at + 100_000])], schema=schema)

    def run(batches):
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for data in batch.column(0):
                _, _, _, sizes, words, _, trained, _ = unpack(data.as_py())
                total += int(sizes.sum())
                some = trained > 0
                keys, place = np.unique(np.concatenate([keys, words[some]]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, trained[some]]), len(keys)).astype(np.int64)
                if len(keys) > COUNTED:
                    yield from out(0, keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from out(0, keys, counts)
        yield from out(1, np.zeros(1, np.int64), np.array([total]))

    return chunked.select("data").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest training words, `bound` at most, and their counts."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("long")
    words = counts.filter("kind = 0")
    levels = sorted(((r[0], r[1]) for r in words.groupBy(level).count().collect()), reverse=True)  # a few hundred at most
    total, least = 0, math.inf
    for k, n in levels:
        total += n
        if total > bound:
            break
        least = k
    got = words.filter(level >= (least if levels and least < math.inf else 1 << 30)).select("key", "n").toArrow()
    keys, n = got.column("key").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _row(kind: int, at: int, source: int, data: bytes | None, counts=None, hot=None) -> tuple:
    return kind, at, source, data, counts, hot


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def route(chunked: DataFrame, model: dict) -> DataFrame:
    """Rows of PART: of each chunk its pairs at home in a part, with the number of training tokens of each."""
    sent = chunked.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                _, _, train, sizes, keys, _, plan = open_chunk(data, sent.value)
                counts = np.bincount(plan.pair[np.repeat(train, sizes)], minlength=len(plan.part))
                rows = []
                for p, a, b in plan.parts():
                    first, context = np.unique(plan.context[a:b], return_index=True)
                    words, place = np.unique(plan.word[a:b], return_inverse=True)
                    runs = np.diff(context, append=b - a)
                    rows.append(_row(PART, p, chunk, pack(*key_arrays(keys[first]), *key_arrays(keys[words]), runs, place, counts[a:b])))
                    if len(rows) == 64:
                        yield from _table(rows).to_batches()
                        rows = []
                if rows:
                    yield from _table(rows).to_batches()

    return chunked.mapInArrow(run, ROWS)


class Part:
    """Whole restaurants of some contexts, and shares of hot ones: dishes, their customers, and which of them a chunk has."""

    def __init__(self, blobs: list[tuple[int, bytes]]):
        found = [(chunk, unpack(raw)) for chunk, raw in blobs]
        read = [(c, keys_from(a[0], a[1]), keys_from(a[2], a[3]), *a[4:]) for c, a in found]
        self.contexts = np.unique(np.concatenate([r[1] for r in read]))
        self.words = np.unique(np.concatenate([r[2] for r in read]))
        codes = [np.repeat(np.searchsorted(self.contexts, c), runs) << 32 | np.searchsorted(self.words, w)[place] for _, c, w, runs, place, _ in read]
        dishes, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        self.c = np.bincount(inverse, np.concatenate([r[5] for r in read]), len(dishes)).astype(np.int64)
        self.context, self.word = dishes >> 32, dishes & 0xFFFFFFFF
        self.chunks = np.array([r[0] for r in read], np.int64)
        self.sizes = np.array([len(x) for x in codes])
        self.dish = inverse

    def pack(self) -> bytes:
        runs = np.bincount(self.context, minlength=len(self.contexts))
        starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        steps = np.diff(self.dish, prepend=0)
        steps[starts] = self.dish[starts]
        return pack(*key_arrays(self.contexts), *key_arrays(self.words), runs, self.word, self.c, self.chunks.view(np.uint64), self.sizes, steps)

    @classmethod
    def unpack(cls, raw: bytes) -> Part:
        a = unpack(raw)
        self = cls.__new__(cls)
        self.contexts, self.words = keys_from(a[0], a[1]), keys_from(a[2], a[3])
        self.context, self.word, self.c = np.repeat(np.arange(len(self.contexts)), a[4]), a[5], a[6]
        self.chunks, self.sizes = a[7].view(np.int64), a[8]
        total = np.cumsum(a[9])
        before = np.concatenate([[0], total[np.cumsum(self.sizes)[:-1] - 1]])
        self.dish = total - np.repeat(before, self.sizes)
        return self

    def types(self) -> np.ndarray:
        """Of each word, its dishes here that have customers."""
        return np.bincount(self.word[self.c > 0], minlength=len(self.words))

    def context_types(self) -> np.ndarray:
        return np.bincount(self.context[self.c > 0], minlength=len(self.contexts))

    def needed(self) -> np.ndarray:
        """Words whose dishes are reseated here."""
        out = np.zeros(len(self.words), bool)
        out[self.word[self.c > 1]] = True
        return out

    def spread(self, values: np.ndarray, places: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The values of hot keys, at their places among hot."""
        out = np.zeros(len(hot), np.int64)
        at = np.minimum(np.searchsorted(hot, places), max(0, len(hot) - 1))
        good = hot[at] == places if len(hot) else np.zeros(len(places), bool)
        out[at[good]] = values[good]
        return out


def build(group: pa.Table, hot: np.ndarray, parts: int) -> pa.Table:
    """The part of the chunks' rows, and what it needs from the homes of its words: the numbers of its dishes of them."""
    got = sorted(zip(group.column("source").to_pylist(), group.column("data").to_pylist()))
    number = group.column("at")[0].as_py()
    part = Part(got)
    types, needed = part.types(), part.needed()
    totals = [len(part.c), int((part.c > 0).sum()), int((part.c == 1).sum()), int((part.c == 2).sum())]
    extra = np.concatenate([part.spread(types, part.words, hot), part.spread(part.context_types(), part.contexts, hot)])
    rows = [_row(PART, number, number, part.pack(), totals, extra.tolist())]
    home = homes(part.words, hot, parts)
    home[types == 0] = -1
    order = np.argsort(home, kind="stable")
    order = order[home[order] >= 0]
    found, first = np.unique(home[order], return_index=True)
    for q, some in zip(found.tolist(), np.split(order, first[1:])):
        rows.append(_row(NEED, q, number, pack(*key_arrays(part.words[some]), types[some], needed[some])))
    return _table(rows)


def answer(group: pa.Table, model: dict) -> pa.Table:
    """At the words' home: their dishes in all restaurants are one table each at first; the parent seats these tables."""
    at = group.column("at")[0].as_py()
    asked = [(s, unpack(d)) for s, d in sorted(zip(group.column("source").to_pylist(), group.column("data").to_pylist()))]
    keys = [keys_from(a[0], a[1]) for _, a in asked]
    words, place = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(place, np.concatenate([a[2] for _, a in asked])).astype(np.int64)
    ones, twos = int((c == 1).sum()), int((c == 2).sum())
    t = seat_parent(c, 1 / (model["V"] + 1), model["V"] / len(words), PARENT_STRENGTH, discount_of(ones, twos), at, 0)
    rows, done = [_row(TOTAL, at, at, None, [int(c.sum()), int(t.sum()), ones, twos])], 0
    for (source, a), k in zip(asked, keys):
        mine = place[done : done + len(k)][a[3] > 0]
        rows.append(_row(KNOWN, source, at, pack(c[mine], t[mine])))
        done += len(k)
    return _table(rows)


def parent_share(c, t, parent: dict, V: int):
    """The parent's probability of words of c customers and t tables there."""
    return (c - parent["d"] * t + (PARENT_STRENGTH + parent["d"] * parent["T"]) / (V + 1)) / (PARENT_STRENGTH + parent["C"])


def reseat(group: pa.Table, model: dict) -> pa.Table:
    """Gibbs sampling of a part's restaurants, given the parent; what chunks need of it, and its tables for the parent."""
    rows = list(zip(*(group.column(n).to_pylist() for n in ("kind", "source", "data"))))
    number, hot, parts = group.column("at")[0].as_py(), model["hot"], model["parts"]
    part = Part.unpack(next(d for k, _, d in rows if k == PART))
    types, needed = part.types(), part.needed()
    home = homes(part.words, hot, parts)
    prob = np.zeros(len(part.words))
    for source, data in ((s, d) for k, s, d in rows if k == KNOWN):
        c1, t1 = unpack(data)
        prob[(home == source) & needed & (types > 0)] = parent_share(c1, t1, model["parent"], model["V"])
    is_hot = home == -1
    at = np.searchsorted(hot, part.words[is_hot])
    prob[is_hot] = parent_share(model["hot_c"][at], model["hot_t"][at], model["parent"], model["V"])
    own = part.context_types()
    scale = np.ones(len(part.contexts))
    spread = homes(part.contexts, hot, parts) == -1
    scale[spread] = model["hot_types"][np.searchsorted(hot, part.contexts[spread])] / np.maximum(1, own[spread])
    many = np.flatnonzero(part.c > 1)
    samples = [(part.c > 0).astype(np.int64) for _ in range(SAMPLES)]
    if len(many):
        seats = Seating(part.c[many], part.context[many], prob[part.word[many]], own.copy(), scale, STRENGTH, model["d"], number)
        for _ in range(BURN_IN):
            seats.sweep()
        for s in range(SAMPLES):
            for _ in range(BETWEEN):
                seats.sweep()
            samples[s][many] = seats.counts()
    tables = [np.bincount(part.context, t, len(part.contexts)).astype(np.int64) for t in samples]
    more = [np.bincount(part.word, t, len(part.words)).astype(np.int64) - types for t in samples]
    extra = [*(part.spread(m, part.words, hot) for m in more), *(part.spread(t, part.contexts, hot) for t in tables)]
    customers = np.bincount(part.context, part.c, len(part.contexts)).astype(np.int64)
    out, edges = [], np.concatenate([[0], np.cumsum(part.sizes)])
    asked, lengths = [], []
    for chunk, a, b in zip(part.chunks.tolist(), edges, edges[1:]):
        dish = part.dish[a:b]
        mine = np.unique(part.context[dish])
        mine = mine[~spread[mine]]
        asked.append(np.diff(mine, prepend=0))
        lengths.append(len(mine))
        out.append(_row(PAIRS, chunk, number, pack(part.c[dish], *(t[dish] for t in samples), customers[mine], *(t[mine] for t in tables))))
    words = pack(*key_arrays(part.contexts), part.chunks.view(np.uint64), np.array(lengths), np.concatenate(asked))
    out.append(_row(ASKED, number, number, words, None, np.concatenate(extra).tolist()))
    changed = np.flatnonzero(np.any(more, axis=0) & ~is_hot)
    changed = changed[np.argsort(home[changed], kind="stable")]
    found, first = np.unique(home[changed], return_index=True)
    for q, some in zip(found.tolist(), np.split(changed, first[1:])):
        out.append(_row(ADDED, q, number, pack(*key_arrays(part.words[some]), *(m[some] for m in more))))
    return _table(out)


def seat_words(group: pa.Table, model: dict) -> pa.Table:
    """At the words' home: the parent's customers are the tables of all restaurants; they are seated for each sample."""
    rows = sorted(zip(*(group.column(n).to_pylist() for n in ("kind", "source", "data"))))
    at = group.column("at")[0].as_py()
    asked = next((unpack(d) for k, _, d in rows if k == ASKED), None)
    if asked is None:
        return _table([])
    words = keys_from(asked[0], asked[1])
    c = np.zeros((SAMPLES, len(words)), np.int64)
    for kind, _, data in rows:
        if kind in (NEED, ADDED):
            a = unpack(data)
            place = np.searchsorted(words, keys_from(a[0], a[1]))
            for s in range(SAMPLES):
                c[s, place] += a[2] if kind == NEED else a[2 + s]
    tables, totals = [], []
    for s in range(SAMPLES):
        known = max(1, int((c[s] > 0).sum()))
        tables.append(seat_parent(c[s], 1 / (model["V"] + 1), model["V"] / known, PARENT_STRENGTH, model["parent"]["d"], at + (s << 32), 1))
        totals += [int(c[s].sum()), int(tables[s].sum())]
    out, done = [_row(TOTAL, at, at, None, totals)], 0
    for chunk, n in zip(asked[2].view(np.int64).tolist(), asked[3].tolist()):
        mine = np.cumsum(asked[4][done : done + n])
        out.append(_row(WORDS, chunk, at, pack(*c[:, mine], *(t[mine] for t in tables))))
        done += n
    return _table(out)


class Chunk:
    """A chunk's documents with what its words and pairs have in the model."""

    def __init__(self, rows: list[tuple], model: dict):
        self.model, hot = model, model["hot"]
        data = next(d for k, _, d in rows if k == PART)
        self.ids, self.known_ids, self.train, self.sizes, self.keys, self.place, self.plan = open_chunk(data, model)
        plan, n = self.plan, len(self.keys)
        home = plan.home
        self.count, self.tables = np.zeros(n, np.int64), np.zeros((SAMPLES, n), np.int64)
        self.parent_c, self.parent_t = np.zeros((SAMPLES, n), np.int64), np.zeros((SAMPLES, n), np.int64)
        self.c, self.t = np.zeros(len(plan.part), np.int64), np.zeros((SAMPLES, len(plan.part)), np.int64)
        span = {p: (a, b) for p, a, b in plan.parts()}
        for kind, source, raw in rows:
            if kind not in (PAIRS, WORDS):
                continue
            got, own = unpack(raw), np.flatnonzero(home == source)
            if kind == WORDS:
                self.parent_c[:, own], self.parent_t[:, own] = got[:SAMPLES], got[SAMPLES:]
                continue
            a, b = span[source]
            self.c[a:b], self.t[:, a:b] = got[0], got[1 : 1 + SAMPLES]
            self.count[own], self.tables[:, own] = got[1 + SAMPLES], got[2 + SAMPLES :]
        own = np.flatnonzero(home == -1)
        at = np.searchsorted(hot, self.keys[own])
        self.count[own] = model["hot_counts"][at]
        for s in range(SAMPLES):
            m = model["samples"][s]
            self.tables[s, own], self.parent_c[s, own], self.parent_t[s, own] = m["hot_tables"][at], m["hot_c"][at], m["hot_t"][at]

    def parents(self) -> list[np.ndarray]:
        return [parent_share(self.parent_c[s], self.parent_t[s], self.model["samples"][s], self.model["V"]) for s in range(SAMPLES)]

    def probabilities(self) -> np.ndarray:
        """The averaged predictive probability of each pair."""
        d, out = self.model["d"], np.zeros(len(self.c))
        for s, parent in enumerate(self.parents()):
            out += self.c - d * self.t[s] + (STRENGTH + d * self.tables[s])[self.plan.context] * parent[self.plan.word]
        return out / SAMPLES / (STRENGTH + self.count)[self.plan.context]

    def scores(self) -> pa.Table:
        N, V = self.model["N"], self.model["V"]
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        sums = lambda x: np.bincount(doc, x, len(self.sizes))
        score = sums(np.log10(self.probabilities())[self.plan.pair])
        base = sums(np.log10((self.count + 1) / (N + V + 1))[self.place])
        known = sums((self.count > 0)[self.place]).astype(np.int64)
        return pa.table([pa.array(self.ids, mask=~self.known_ids), pa.array(~self.train), pa.array(self.sizes), pa.array(known), pa.array(np.full(len(known), N)), pa.array(base), pa.array(score)], schema=OUT)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _sums(table: DataFrame, name: str, width: int) -> np.ndarray:
    """Sums of a short array over all rows that have it."""
    out = np.zeros(width, np.int64)
    for r in table.filter(F.col(name).isNotNull()).select(F.posexplode(name).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


def _hot_parent(c: np.ndarray, sums: np.ndarray, V: int, d: float, seed: int, sweeps: int) -> tuple[np.ndarray, dict]:
    """Tables of hot words in the parent, given the tables that the parts have of all others (sums[1]), and the parent's discount
    and totals with them."""
    t = seat_parent(c, 1 / (V + 1), 1.0, PARENT_STRENGTH, d, seed, sweeps, int(sums[1]))
    return t, {"d": d, "C": int(sums[0] + c.sum()), "T": int(sums[1] + t.sum())}


def learn(docs: DataFrame, held: Column) -> tuple[DataFrame, dict]:
    """Rows (kind, at, source, data) of each chunk: its documents, and what its pairs and words have in the model; and
    what all chunks share.

    The driver sees sums, the dictionary of common words and counts of hot ones, which are bounded.
    """
    spark = docs.sparkSession
    chunked = materialize(cut_chunks(docs.select("doc_id", "text", held.alias("held"))))
    counts = materialize(count_words(chunked))
    size = counts.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n").alias("total"))
    size = {r["kind"]: (r["n"], r["total"]) for r in size.collect()}
    V, N = size.get(0, (0, 0))
    parts = max(1, -(-size.get(1, (0, 0))[1] // PART_TOKENS))
    common, n = common_words(counts, DICTIONARY)
    discard(counts)
    hot = np.flatnonzero((2 * n > PART_TOKENS) & (n.astype(np.float64) * DICTIONARY >= N))
    hot_counts, hot, width = n[hot], hot.astype(np.uint64), len(hot)
    names = {"common": common, "hot": hot, "parts": parts}
    first = materialize(route(chunked, names).groupBy("at").applyInArrow(lambda g: build(g, hot, parts), ROWS))
    totals, hot_types = _sums(first, "counts", 4), _sums(first, "hot", 2 * width)
    model = {"N": N, "V": V, "parts": parts, "hot": hot, "hot_counts": hot_counts, "d": discount_of(totals[2], totals[3]), "hot_types": hot_types[width:]}
    ask = first.filter(F.col("kind") == NEED)
    told = materialize(ask.groupBy("at").applyInArrow(lambda g: answer(g, model), ROWS))
    sums = _sums(told, "counts", 4)
    hot_t, parent = _hot_parent(hot_types[:width], sums, V, discount_of(sums[2], sums[3]), SAMPLES, 0)
    model |= {"parent": parent, "hot_c": hot_types[:width], "hot_t": hot_t}
    ready = first.filter(F.col("kind") == PART).unionByName(told.filter(F.col("kind") == KNOWN)).drop("counts", "hot")
    second = materialize(ready.groupBy("at").applyInArrow(lambda g: reseat(g, model), ROWS))
    hot_sums = _sums(second, "hot", 2 * SAMPLES * width).reshape(2 * SAMPLES, width)
    home = ask.unionByName(second.filter(F.col("kind").isin(ADDED, ASKED))).drop("counts", "hot")
    third = materialize(home.groupBy("at").applyInArrow(lambda g: seat_words(g, model), ROWS))
    discard(first)
    discard(told)
    sums = _sums(third, "counts", 2 * SAMPLES).reshape(SAMPLES, 2)
    model["samples"] = []
    for s in range(SAMPLES):
        c = hot_types[:width] + hot_sums[s]
        t, parent = _hot_parent(c, sums[s], V, model["parent"]["d"], s, 1)
        model["samples"].append(parent | {"hot_c": c, "hot_t": t, "hot_tables": hot_sums[SAMPLES + s]})
    about = chunked.select(F.lit(PART).cast("byte").alias("kind"), F.col("chunk").alias("at"), F.lit(0).cast("long").alias("source"), "data")
    pairs, words = second.filter(F.col("kind") == PAIRS), third.filter(F.col("kind") == WORDS)
    return about.unionByName(pairs.select(about.columns)).unionByName(words.select(about.columns)), model | {"common": common}


def score(docs: DataFrame, held: Column) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of its probability).

    Tokens are words and one end; a null text is its end alone. held says whose tokens aren't learned from; a null
    counts as false. Rows may repeat, each is scored; other columns don't matter; an empty table gives no rows. Very
    long texts are whole: a chunk has one document at least. Without training tokens every token has probability 1.

    Every word before has a restaurant of its own; their parent is the restaurant of all words, over equal shares of the
    V words and one unknown. A part of the model holds whole restaurants, but those of words with more than half of
    PART_TOKENS customers are spread over the parts by their dishes. From one table a dish, the parent seats the
    tables; then every customer of every dish is reseated in full sweeps, given the restaurant's tables (of spread ones as
    the part's own tell) and the parent; then the parent seats the tables of each sample. Probabilities use the tables
    and customers that all parts have, and sum to one over words in every context.
    """
    rows, model = learn(docs, F.coalesce(held, F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def add(group: pa.Table) -> pa.Table:
        got = list(zip(*(group.column(n).to_pylist() for n in ("kind", "source", "data"))))
        return Chunk(got, sent.value).scores()

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("at").applyInArrow(add, kinds)
