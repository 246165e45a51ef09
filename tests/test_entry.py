"""The registered queries against their SQL on the smallest tables, and the guard about the text operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from namesake.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", ["target_author", "name_scores", "feedback_all", "derived_feedback", "candidates_orcid_union", "merge_keep", "upsert_identities", "insert_articles", "link_uploads", "link_found", "upsert_scores", "candidates_cascade", "incremental_window", "roc_auc", "roc_points", "pr_curve", "average_precision", "calibration_bins", "orcid_inference", "score_export", "institution_names", "derived_lookups", "wilson_bounds", "name_keys", "score_safety_net", "score_metrics", "training_gates", "score_cache_misses", "derived_subfields", "text_values", "retrieval_log", "wiped_rows", "score_summary"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((plain(r) for r in want.fetchall()), key=str)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["person_id", "pmid"]


def test_imports_without_the_text_operators(tmp_path):
    """Everything else still imports where the subpackage and the pipeline are gone."""
    root = Path(__file__).resolve().parents[1]
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('namesake.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name='namesake.llm')\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e, bench\n"
        "assert e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
