"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, merkle, near_dups, packing, pii, pitman_yor, quality, sharding, token_counts, toxicity, whitening
from .common import held_out, read
from .sql import BENCHMARK_SQL, LINES_SQL, MERKLE_SQL, NEAR_DUPS_SQL, SHARDS_SQL


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    out = held_out(F.col("doc_id"), 4, 2)
    found = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op3_pitman_yor(spark, sf_dir):
    return pitman_yor.score(read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    found = language_id.identify(docs, language_id.labelled_sample(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_decontaminate(spark, sf_dir):
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_pii(spark, sf_dir):
    return pii.report(read(spark, sf_dir, "documents"))


def op9_near_dups(spark, sf_dir):
    return near_dups.find(read(spark, sf_dir, "documents"), percent=85, size=3, count=48, rows=7)


def op10_jump_shard(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"))


def op11_line_dedup(spark, sf_dir):
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op12_merkle(spark, sf_dir):
    return merkle.report(read(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_near_dups": op9_near_dups,
    "op10_jump_shard": op10_jump_shard,
    "op11_line_dedup": op11_line_dedup,
    "op12_merkle": op12_merkle,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op7_decontaminate": BENCHMARK_SQL,
    "op9_near_dups": NEAR_DUPS_SQL,
    "op10_jump_shard": SHARDS_SQL,
    "op11_line_dedup": LINES_SQL,
    "op12_merkle": MERKLE_SQL,
}
