"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize
from .graph import components

MASK = (1 << 64) - 1
FULL = np.uint64(MASK)
#: A verification unit holds so many shingles from each of its two sides, or one document.
UNIT_SHINGLES = 1 << 17
#: And about so many sets, as it compares all pairs of sets in one matrix.
UNIT_SETS = 1 << 11


class WordHash(dict):
    """64-bit hashes of words, kept as long as they are few."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 1_000_000:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, table: WordHash, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words of the ASCII-lower-cased text.

    Fewer words than that are one run; no words, none. Words part at ASCII white space.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    runs = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        runs = mix(runs)
    return np.unique(runs)


def sketches(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Fast similarity sketches of sets that aren't empty: (set, width), each coordinate a round and a hash.

    In round i < width every element falls into a hashed bin with a hashed value; bins keep the least value of the
    first round that reaches them, so that sets of many elements are done after a few rounds. In round width + j all
    elements fall into bin j: after 2 * width rounds every coordinate is filled. Two sets agree in a coordinate with
    the probability of their Jaccard similarity, and the number of agreements is concentrated about its mean.
    """
    out = np.full(len(sets) * width, FULL, np.uint64)
    if not sets:
        return out.reshape(0, width)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * width):
        seed = np.uint64((i + 1) * 0xD6E8FEB86659FD93 & MASK)
        h = mix(items ^ seed)
        bins = ((h >> np.uint64(40)) * np.uint64(width) >> np.uint64(24)).astype(np.int64) if i < width else i - width
        low = h & np.uint64((1 << 40) - 1)
        np.minimum.at(out, owner * width + bins, np.uint64(i) << np.uint64(48) | low)
        left = (out.reshape(-1, width) == FULL).any(1)
        if not left.any():
            break
        if i % 4 == 3 or i < 4:
            keep = left[owner]
            items, owner = items[keep], owner[keep]
    return out.reshape(-1, width)


def bands(sketch: np.ndarray, count: int, rows: int) -> np.ndarray:
    """(set, count): a hash of each run of `rows` coordinates, different for each run's place."""
    parts = sketch.reshape(len(sketch), count, rows)
    out = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (len(sketch), count)).copy()
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def sketch_documents(docs: DataFrame, count: int, rows: int, size: int) -> DataFrame:
    """doc_id, n (size of the set), fp (128-bit digest of the set; null if empty) and bands of every whole text."""

    def make():
        table = WordHash()

        def work(part):
            sets = [shingles(t, table, size) for t in part["text"]]
            some = [k for k, s in enumerate(sets) if len(s)]
            found: list = [[]] * len(sets)
            for k, b in zip(some, bands(sketches([sets[k] for k in some], count * rows), count, rows).view(np.int64).tolist()):
                found[k] = b
            fps = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return {"doc_id": part["doc_id"], "n": [len(s) for s in sets], "fp": fps, "bands": found}

        return work

    return map_texts(docs, make, "doc_id long, n long, fp binary, bands array<long>")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component (smallest place) of each set under links of 100 * intersection >= percent * union.

    Intersections of all sets of a unit come from products of 0/1 matrices, a block of shared shingles at a time.
    """
    n = np.array([len(s) for s in sets])
    items, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(where, minlength=len(items)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[where]
    owner, where = owner[keep], column[where[keep]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    block = max(256, (1 << 22) // max(1, len(sets)))
    for at in range(0, int(shared.sum()), block):
        a, b = np.searchsorted(where, [at, at + block])
        part = np.zeros((len(sets), block), np.float32)
        part[owner[a:b], where[a:b] - at] = 1
        both += part @ part.T
    links = np.empty(both.shape, bool)
    for k in range(0, len(sets), 256):
        some = both[k : k + 256].astype(np.int64)
        links[k : k + 256] = 100 * some >= percent * (n[k : k + 256, None] + n[None, :] - some)
    label = np.full(len(sets), -1)
    for k in range(len(sets)):
        if label[k] < 0:
            front = np.array([k])
            label[k] = k
            while len(front):
                front = np.flatnonzero(links[front].any(0) & (label < 0))
                label[front] = k
    return label


def _verify(percent: int, size: int):
    table = WordHash()

    def work(group: pa.Table) -> pa.Table:
        ids = group.column("nid").to_pylist()
        label = linked([shingles(t, table, size) for t in group.column("text").to_pylist()], percent)
        pairs = {(ids[k], ids[i]) for i, k in enumerate(label) if ids[i] != ids[k]}
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return work


def place(members: DataFrame, percent: int) -> DataFrame:
    """(nid, family, unit) of members (nid, family, n): two of a family that can link by their sizes share a unit."""
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int").alias("level")
    members = materialize(members.select("nid", "family", "n", level))
    parts = F.greatest(F.ceil(F.sum("n") / F.lit(UNIT_SHINGLES)), F.ceil(F.count("*") / F.lit(UNIT_SETS)))
    totals = members.groupBy("family", "level").agg(parts.cast("int").alias("parts"))
    above = totals.select("family", (F.col("level") - 1).alias("level"), F.col("parts").alias("above"))
    below = totals.select("family", (F.col("level") + 1).alias("level"), F.col("parts").alias("below"))
    sized = totals.join(above, ["family", "level"], "left").join(below, ["family", "level"], "left").na.fill(0, ["above", "below"])
    placed = members.join(sized, ["family", "level"]).withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
    unit = lambda level, p, q: F.struct(level.alias("level"), p.alias("p"), q.alias("q"))
    range_to = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(range_to(F.col("parts")), lambda i: unit(2 * F.col("level"), F.least(i, F.col("part")), F.greatest(i, F.col("part"))))
    up = F.transform(range_to(F.col("above")), lambda i: unit(2 * F.col("level") + 1, F.col("part"), i))
    down = F.transform(range_to(F.col("below")), lambda i: unit(2 * F.col("level") - 1, i, F.col("part")))
    return placed.select("nid", "family", F.explode(F.concat(own, up, down)).alias("unit"))


def find(docs: DataFrame, percent: int = 80, size: int = 5, count: int = 56, rows: int = 6) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept.

    Documents link if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id
    that links reach, kept says that it is the document's own. A text without words has an empty set and links with
    nothing. Rows of one doc_id are one document; a null doc_id takes part only through an equal set under another id,
    and is never kept. Equal sets are one class from the start, so that copies cost nothing further. Very long texts are
    sketched and verified whole; other columns, of any name, aren't read; an empty table gives no rows.

    A band shared by classes makes them candidates. With 56 bands of 6 a pair at 80 per cent shares none four times in
    10^8 cases, with 48 bands of 7 one at 85 per cent once in 10^8. Candidates that hang together are a family; its classes go into units by size (sizes further apart than the
    threshold can't link) and, where a family is large, by hash into parts, of which each pair is a unit. So a unit is
    bounded however large a family, and all its pairs are verified on whole sets. Only links that hold a unit's
    components together are written.
    """
    base = materialize(sketch_documents(docs, count, rows, size))
    known = base.filter(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("nid"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    spread = classes.select("nid", F.explode("bands").alias("h"))
    hubs = spread.groupBy("h").agg(F.min("nid").alias("hub"), F.max("nid").alias("last")).filter("hub <> last").select("h", "hub")
    candidates = spread.join(hubs, "h").filter("nid <> hub").select(F.col("hub").alias("a"), F.col("nid").alias("b")).distinct()
    families = components(candidates).select(F.col("node").alias("nid"), F.col("label").alias("family"))

    units = place(families.join(classes.select("nid", "n"), "nid"), percent)
    texts = docs.select(F.col("doc_id").alias("nid"), "text").join(units, "nid")
    found = texts.groupBy("family", "unit").applyInArrow(_verify(percent, size), "a long, b long")
    final = components(found.distinct()).select(F.col("node").alias("nid"), F.col("label"))

    named = base.select("doc_id", "n", "fp").join(classes.select("fp", "nid"), "fp", "left").join(final, "nid", "left")
    component = F.coalesce("label", "nid", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that near_dups.find doesn't keep; rows without an id stay."""
    dropped = find(docs, **options).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
