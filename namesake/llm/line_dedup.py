"""Lines that many documents share, found with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, materialize, shared_dir

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; pure ASCII takes the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hashes(key: Column) -> list[Column]:
    """The key's hash in 128 bits: of n different keys two meet with a chance of about n * n / 10^39."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")]


def document_counts(docs: DataFrame, *by: Column) -> DataFrame:
    """(*by, a, b, n): in how many documents each line key stands; a key counts once in a document, an empty one never."""
    lines = F.split(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), "\n", -1)
    keys = F.array_distinct(F.transform(lines, lambda line: F.btrim(line, F.lit(WHITE))))
    rows = docs.select(*by, F.explode(keys).alias("key")).filter("key <> ''").select("*", *hashes(F.col("key"))).drop("key")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


class Runs:
    """Sorted runs of (a, b, n) in levels, and the keys that have reached `enough` documents.

    A run is a bucketed, sorted table. A batch drops the keys that are settled by a merge anti-join and becomes a run of
    level 0. Two runs of a level are merged into one of the next level, so a key is written again only as often as there
    are levels, about the logarithm of the batches. Buckets meet their like without a shuffle in all merges. A key that
    reaches `enough` in a merge leaves the runs and is settled.
    """

    def __init__(self, spark: SparkSession, enough: int, buckets: int | None = None):
        self.spark, self.enough = spark, enough
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.settled: list[str] = []

    def write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        sorted_buckets = rows.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b")
        sorted_buckets.option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name, format="parquet")
        return name

    def drop(self, name: str) -> None:
        discard(self.spark.table(name))
        self.spark.sql(f"DROP TABLE {name}")

    def add(self, counts: DataFrame) -> None:
        """Take a batch's counts (a, b, n), each key once."""
        rows = counts.select("a", "b", "n").repartition(self.buckets, "a", "b")
        for name in self.settled:
            rows = rows.join(self.spark.table(name).select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        self.place(self.write(rows), 0)

    def place(self, name: str, level: int) -> None:
        """Put a run at a level; where another stands there, both are merged into the next one."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == 2:
            pair, self.levels[level] = self.levels[level], []
            self.place(self.merge(*pair), level + 1)

    def merged(self, x: str, y: str) -> DataFrame:
        left, right = self.spark.table(x), self.spark.table(y).withColumnRenamed("n", "m")
        total = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return left.hint("merge").join(right, ["a", "b"], "full").select("a", "b", total.alias("n"))

    def merge(self, x: str, y: str) -> str:
        """One run of two; keys with enough documents go to a run of settled ones. Both outputs read the two runs anew,
        which costs less than a table between."""
        both = self.merged(x, y)
        reached, rest = self.write(both.filter(F.col("n") >= self.enough)), self.write(both.filter(F.col("n") < self.enough))
        self.drop(x)
        self.drop(y)
        if self.spark.table(reached).isEmpty():
            self.drop(reached)
        else:
            self.settle(reached)
        return rest

    def settle(self, name: str) -> None:
        """Keep one run of settled keys: they are few beside all keys."""
        if self.settled:
            [old] = self.settled
            self.settled = [self.write(self.merged(old, name))]
            self.drop(old)
            self.drop(name)
        else:
            self.settled = [name]

    def close(self) -> DataFrame:
        """Merge what is left, the lower levels first; (a, b) of all keys with enough documents, each once."""
        names = [name for level in self.levels for name in level]
        self.levels = []
        while len(names) > 1:
            names = [self.merge(names[0], names[1]), *names[2:]]
        if names:
            last = self.spark.table(names[0]).filter(F.col("n") >= self.enough)
            if not last.isEmpty():
                self.settle(self.write(last))
            self.drop(names[0])
        return self.spark.table(self.settled[0]).select("a", "b") if self.settled else self.spark.createDataFrame([], "a long, b long")


def common_lines(docs: DataFrame, enough: int = 10, batches: int = 4) -> DataFrame:
    """(a, b) of the line keys that stand in `enough` documents or more.

    The texts are read once: their counts are written in batches of documents, which the runs then take one by one.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    counts = materialize(document_counts(docs, batch), "batch")
    runs = Runs(spark, enough)
    for i in range(batches):
        runs.add(counts.filter(F.col("batch") == i))
    discard(counts)
    return runs.close()


def drop_lines(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, text without the lines whose keys are common, n_lines (before), n_dropped.

    What a text loses depends on the text alone, so the places of its common lines are gathered for each text, whatever the
    number of its copies, and meet the rows by the text's hash. Spark broadcasts the common keys and the places where
    they are small by its own threshold, and else sorts and splits hot ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("s"), F.xxhash64(F.lit(1), text).alias("t"))
    lines = rows.select("s", "t", F.posexplode(F.split(lower_ascii(F.col("text")), "\n", -1)).alias("at", "line"))
    keys = lines.select("s", "t", "at", F.btrim("line", F.lit(WHITE)).alias("key")).filter("key <> ''").select("s", "t", "at", *hashes(F.col("key")))
    places = keys.join(common, ["a", "b"], "left_semi").groupBy("s", "t").agg(F.collect_set("at").alias("gone"))

    def make():
        def work(got):
            texts, lines, dropped = [], [], []
            for text, gone in zip(got["text"], got["gone"], strict=True):
                parts, gone = text.split("\n"), set(gone or ())
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
                lines.append(len(parts))
                dropped.append(len(gone))
            return {"doc_id": got["doc_id"], "text": texts, "n_lines": lines, "n_dropped": dropped}

        return work

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long"
    return map_texts(rows.join(places, ["s", "t"], "left"), make, schema, ("doc_id", "text", "gone"))


def deduplicate(docs: DataFrame, enough: int = 10, batches: int = 4) -> DataFrame:
    """doc_id, text without the lines that `enough` documents share, n_lines (before), n_dropped.

    Lines end at \\n; a line's key is the line without white space at both ends, A-Z in lower case. All lines of a shared
    key go, in every document; empty keys stay. Null and empty texts are one empty line. Each row is a document: repeated
    rows count once each and get equal results, and a null id is as good as any. A key at just `enough` goes. Texts are
    split in one task each, whatever their length. Other columns, of any name, aren't read; an empty table gives no rows.
    """
    return drop_lines(docs, common_lines(docs, enough, batches))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of deduplicate()."""
    return deduplicate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
