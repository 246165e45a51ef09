"""Texts against tables of words, and names against names, where expressions grow too long or too slow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

#: Letters by which words are looked for in texts before they are compared.
GRAM = 3


def keyword_matches(rows: DataFrame, text: str, groups: DataFrame, name: str) -> DataFrame:
    """Add to rows whether the text has all words of one of the groups (group, word), wherever in it and in any case.

    Different texts meet the words by their runs of GRAM letters: a word can only be where its first letters are, so the join
    is on these, and each hit is then compared whole. Words of fewer letters join by all of theirs. What counts is how
    many different words of a group a text has. An empty word is in every text.
    """
    words = groups.select("group", F.lower(F.trim("word")).alias("word")).distinct()
    sizes = words.groupBy("group").agg(F.count("*").alias("size"), F.count_if(F.col("word") == "").alias("empty"))
    texts = rows.select(F.coalesce(F.lower(F.col(text)), F.lit("")).alias("_text")).distinct()
    starts = F.sequence(F.lit(1), F.length("_text"))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(F.col("_text"), i, n)))))
    runs = texts.filter("_text <> ''").select("_text", F.explode(grams).alias("_gram"))
    found = runs.join(words.filter("word <> ''").withColumn("_gram", F.substring("word", 1, GRAM)), "_gram").filter(F.contains("_text", "word"))
    counted = found.groupBy("_text", "group").agg(F.count_distinct("word").alias("n"))
    hits = counted.join(sizes, "group").filter(F.col("n") + F.col("empty") == F.col("size")).select("_text", F.lit(True).alias("_hit")).distinct()
    always = sizes.filter("size = empty").agg((F.count("*") > 0).alias("_always"))
    out = rows.withColumn("_text", F.coalesce(F.lower(F.col(text)), F.lit(""))).join(hits, "_text", "left").join(F.broadcast(always))  # one row
    return out.withColumn(name, F.coalesce("_hit", "_always")).drop("_text", "_hit", "_always")


def _codes(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The names' code points, padded with zeros, and their lengths."""
    text = [x or "" for x in names.to_pylist()]
    lengths = np.array([len(x) for x in text], np.int64)
    out = np.zeros((len(text), max(1, int(lengths.max(initial=0)))), np.int32)
    flat = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4")
    out[np.repeat(np.arange(len(text)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths


def jaro_winkler_pairs(left: pa.Array, right: pa.Array) -> np.ndarray:
    """functions.strings.jaro_winkler() of pairs side by side: the i-th letters of all left names take their first free partner at
    once, so the steps are as many as the longest name has letters."""
    (x, n), (y, m) = _codes(left), _codes(right)
    size = max(x.shape[1], y.shape[1])
    x, y = (np.pad(a, ((0, 0), (0, size - a.shape[1]))) for a in (x, y))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    place = np.arange(size)
    taken, matched = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        near = (np.abs(place - i) <= reach[:, None]) & (place < m[:, None])
        free = near & (y == x[:, i : i + 1]) & ~taken & (i < n)[:, None]
        hit = free.any(axis=1)
        taken[hit, free[hit].argmax(axis=1)] = True
        matched[:, i] = hit
    k = matched.sum(axis=1)
    rank = lambda a, on: np.take_along_axis(a, np.argsort(~on, axis=1, kind="stable"), 1)  # noqa: E731  matched letters first
    off = ((rank(x, matched) != rank(y, taken)) & (place < k[:, None])).sum(axis=1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(k > 0, (k / n + k / m + (k - off) / k) / 3, 0.0)
    same = (x == y)[:, :4] & (place[:4] < np.minimum(n, m)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    value = np.where((n == 0) | (m == 0), 0.0, jaro + prefix * 0.1 * (1 - jaro))
    return np.where((n == m) & (x == y).all(axis=1), 1.0, value)


def jaro_winkler_batches(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add the similarity of two columns to rows, in Arrow batches; nulls count as empty."""
    left, right = rows.columns.index(a), rows.columns.index(b)
    schema = StructType(list(rows.schema.fields)).add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = jaro_winkler_pairs(batch.column(left), batch.column(right))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)
