from collections import Counter

import corpus_pipeline
from namesake.llm import decontaminate, near_dups, packing, pii
from namesake.llm.common import materialize, read


def test_each_stage_against_its_own_input(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = before = read(spark, sf, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == before.columns
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows, old = out.collect(), docs.collect()
        if name == "language ID":
            assert {r.doc_id for r in old} - {r.doc_id for r in rows} == {r.doc_id for r in old if not any(c.isalpha() for c in r.text or "")}
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in rows} == {r.doc_id for r in near_dups.find(docs).collect() if r.kept} and len(rows) < len(old)
        elif name == "benchmark decontamination":
            bad = {r.doc_id for r in decontaminate.report(docs, read(spark, sf, "benchmark")).collect() if r.contaminated}
            assert bad and {r.doc_id for r in old} - {r.doc_id for r in rows} == bad
        elif name == "PII":
            assert len(rows) == len(old) and not any(pii.base_spans(r.text) for r in rows)
        else:
            want = packing.pieces(docs, __import__("public_tokenizers").path(packing.TOKENIZER)).collect()
            assert Counter(tuple(r)[:5] for r in rows) == Counter(map(tuple, want))
        docs = out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, kept string, score string, nid string"


def test_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, repeated rows and ids, an empty and a very long text, and columns named as the operators' own."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    body = " ".join(words)
    rows = [(1, body), (2, body), (3, body + " more"), (None, body), (4, None), (5, ""), (6, "12 34"), (7, "other text altogether here"), (7, "other text altogether here"), (8, "mail a@b.cc now please"), (9, "x y z " * 30_000), (6, "letters under an id that also has none")]
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None, "a", None, "b", "c") for k, (i, t) in enumerate(rows)], SCHEMA)
    left = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = materialize(stage(spark, left, "/root/testdata/sf0.001"))
        assert left.columns == docs.columns, name
    got = sorted(((r.doc_id, r.text[:25]) for r in left.collect()), key=str)
    same = body[:25]
    assert got == sorted([(1, same), (None, same), (6, "letters under an id that "), (7, "other text altogether here"[:25]), (7, "other text altogether here"[:25]), (8, "mail [email] now please"), (9, ("x y z " * 9)[:25])], key=str)
    packed = corpus_pipeline.pack_documents(spark, left, "/root/testdata/sf0.001")
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in got}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0, name
