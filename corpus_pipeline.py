"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesake.llm import decontaminate, language_id, near_dups, packing, pii
from namesake.llm.common import held_out, materialize, read


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found: those without a letter or a text go, and all if no text has a language to learn from."""
    return language_id.keep_identified(docs, language_id.labelled_sample(docs, ~held_out(F.col("doc_id"), 3, 1)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 80 per cent of 5-word shingles; rows without an id stay."""
    return near_dups.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows; those without words stay."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the kind in brackets in place of personal data; null texts stay."""
    return pii.redact(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's text, placed in a sequence; a null text is the end alone."""
    return packing.pack(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each on what the one before wrote."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
