"""Benchmark decontamination: word windows of documents found among those of benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed value: a word is a run of characters outside this ASCII class (letters are lower-cased first).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark windows up to this number are broadcast; beyond it the join shuffles both sides.
BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _pairs(left: Column, right: Column) -> Column:
    """Hashes of the pairs of two arrays of hashes."""
    return F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))


def with_hashes(rows: DataFrame, longest: int) -> DataFrame:
    """Adds columns h1, h2, h4, ...: the hashes of each run of that many words of w, each made of two of half its length."""
    rows = rows.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    k = 1
    while 2 * k <= longest:
        kept = F.greatest(F.lit(0), F.size(f"h{k}") - k)
        rows = rows.withColumn(f"h{2 * k}", _pairs(F.slice(f"h{k}", F.lit(1), kept), F.slice(f"h{k}", F.lit(1 + k), kept)))
        k *= 2
    return rows


def _windows(length: int) -> Column:
    """The hash of each run of `length` words, from the columns of with_hashes; empty where there are fewer words."""
    number = F.greatest(F.lit(0), F.size("w") - (length - 1))
    out, at = None, 0
    for k in (1 << b for b in reversed(range(length.bit_length())) if length >> b & 1):
        part = F.slice(f"h{k}", F.lit(1 + at), number)
        out, at = part if out is None else _pairs(out, part), at + k
    return out


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(h, window, length, items): the distinct windows of the items. Items without words have none.

    An item with a null item_id has windows like any other, but no name: items can be empty.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    # the length is a column before the words are exploded, so that no row made of them carries all words
    items = items.withColumn("length", F.least(F.size("w"), F.lit(n)))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.slice("w", i, F.col("length")))
    cut = items.select("item_id", "length", F.explode(runs).alias("w"))
    h = F.coalesce(*[F.when(F.col("length") == k, F.try_element_at(_windows(k), F.lit(1))) for k in range(1, n + 1)])
    return with_hashes(cut, n).groupBy(h.alias("h"), F.array_join("w", " ").alias("window"), "length").agg(F.collect_set("item_id").alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (sorted as strings), spans (array of start, end in words), copies.

    Benchmark items with a null item_id hit words like any other, and aren't among items. Rows are told apart by doc_id and
    the hash of the text; equal rows become one with their number in `copies`. A null text has no words. Ids may be null.
    The work on a text is in proportion to its length, hits and all. Other columns aren't read.
    """
    wanted = materialize(benchmark_windows(benchmark, n))
    lengths = sorted(r[0] for r in wanted.select("length").distinct().collect())  # n values at most
    size = wanted.count()
    few = size <= BROADCAST_WINDOWS

    key = F.xxhash64("text").alias("key")
    rows = with_hashes(docs.select("doc_id", key, words(F.col("text")).alias("w")), max(lengths, default=1))
    mark = F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("h"))

    def found(length: int) -> Column:
        return F.transform(_windows(length), lambda h, i: F.struct(i.alias("pos"), F.lit(length).alias("len"), h.alias("h")))

    # a window's row has its place and hash only, so that what is carried is linear in the text
    scanned = rows.withColumn("n", F.size("w")).select("doc_id", "key", "n", F.explode(F.concat(F.array(mark), *[found(k) for k in lengths])).alias("at"))
    scanned = scanned.select("doc_id", "key", F.when(F.col("at.pos") < 0, F.col("n")).alias("n_words"), "at.pos", "at.len", "at.h")
    side = wanted.select("h", "window")
    if few:
        joined = scanned.join(F.broadcast(side), "h", "left").filter(F.col("window").isNotNull() | (F.col("pos") < 0)).drop("h")
    else:
        marks = scanned.filter("pos < 0").withColumn("window", F.lit(None).cast("string")).drop("h")
        joined = marks.unionByName(scanned.filter("pos >= 0").join(side, "h").drop("h"))
    joined = materialize(joined)

    # A document's hits by hash become one row, which meets the document's words once and is verified against them.
    hit = F.when(F.col("pos") >= 0, F.struct("pos", (F.col("pos") + F.col("len")).alias("end"), "window"))
    counted = joined.groupBy("doc_id", "key").agg(F.max("n_words").cast("long").alias("n_words"), F.count("n_words").alias("copies"), F.collect_set(hit).alias("hits"))
    counted = materialize(counted)  # small; read three times below
    hits = counted.filter(F.size("hits") > 0).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    asked = hits.select("_id", "_key")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_WINDOWS else asked
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    own = docs.select("doc_id", key, "text").join(asked, same, "left_semi").select("doc_id", "key", words(F.col("text")).alias("w"))
    real = F.filter("hits", lambda h: h["window"] == F.array_join(F.slice("w", h["pos"] + 1, h["end"] - h["pos"]), " "))
    verified = hits.join(own, same).select("doc_id", "key", "n_words", "copies", real.alias("hits"))
    marked = lambda rows: rows.select("doc_id", "key", "n_words", "copies", F.array_sort(F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), h["end"].alias("end")))).alias("spans"), F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("windows"))
    # equal rows have equal hits: one of them stays for all
    kept = marked(counted.filter(F.size("hits") == 0)).unionByName(marked(verified).dropDuplicates(["doc_id", "key"]))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["pos"]))).cast("long").alias("n")),
        lambda s: s["n"],
    )
    per_doc = materialize(kept.withColumn("n_hit", covered))  # small; read three times below
    clean = per_doc.filter(F.size("windows") == 0).withColumn("items", F.array().cast("array<string>"))
    names = wanted.select("window", F.explode("items").alias("item"))
    names = F.broadcast(names) if few else names
    dirty = per_doc.filter(F.size("windows") > 0)
    items = dirty.select("doc_id", "key", F.explode("windows").alias("window")).join(names, "window").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    items = items.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "items")
    dirty = dirty.join(items, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key")), "left").drop("_id", "_key")
    dirty = dirty.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return clean.unionByName(dirty).select("doc_id", "key", "n_words", "n_hit", "items", "spans", "copies")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, per_hit: int = 20) -> DataFrame:
    """Per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if it has hit words and they are at least one in per_hit of its words: just one in per_hit is
    enough. Null and empty texts have no words and are clean; repeated rows each get their row. Very long texts are read
    whole. An empty benchmark hits nothing; an empty table gives no rows. Other columns, of any name, aren't read.
    """
    hits = find_hits(docs, benchmark, n)
    rows = hits.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * per_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _runs(spans: Column) -> Column:
    """Sorted spans (pos, end) joined where they touch or overlap."""
    def add(runs: Column, x: Column) -> Column:
        touch = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] >= x["pos"])
        longer = F.struct(F.try_element_at(runs, F.lit(-1))["pos"].alias("pos"), F.greatest(F.try_element_at(runs, F.lit(-1))["end"], x["end"]).alias("end"))
        return F.when(touch, F.concat(F.slice(runs, 1, F.greatest(F.lit(0), F.size(runs) - 1)), F.array(longer))).otherwise(F.concat(runs, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<struct<pos:int,end:int>>"), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = 13, per_hit: int = 20) -> DataFrame:
    """The documents with the benchmark taken out: all their columns, in any number.

    action 'documents' drops contaminated documents; 'spans' keeps every row and cuts runs of hit words, with all that
    stands between them, out of its text.
    """
    flagged = (F.col("n_hit") > 0) & (F.col("n_hit") * per_hit >= F.col("n_words")) if action == "documents" else F.col("n_hit") > 0
    hits = find_hits(docs, benchmark, n).filter(flagged).select(F.col("doc_id").alias("_hit_id"), F.col("key").alias("_hit_key"), _runs(F.col("spans")).alias("_hit_spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_key"))
    if action == "documents":
        return docs.join(hits, same, "left_anti")
    plain = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    tokens = F.regexp_extract_all("text", F.lit(plain), F.lit(0))
    gaps = F.split("text", plain, -1)
    inside = lambda i: F.exists("_hit_spans", lambda s: (s["pos"] <= i) & (i < s["end"]))
    between = lambda i: F.exists("_hit_spans", lambda s: (s["pos"] < i) & (i < s["end"]))
    pairs = F.zip_with(gaps, tokens, lambda g, t: F.struct(g.alias("gap"), t.alias("word")))
    left = F.transform(pairs, lambda x, i: F.concat(F.when(between(i), F.lit("")).otherwise(x["gap"]), F.coalesce(F.when(~inside(i), x["word"]), F.lit(""))))
    cut = docs.join(hits, same, "left")
    return cut.select(*[F.when(F.col("_hit_spans").isNull(), F.col("text")).otherwise(F.array_join(left, "")).alias("text") if c == "text" else docs[c] for c in docs.columns])
