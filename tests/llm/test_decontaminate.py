import hashlib
import random
import re

import pytest

from namesake.llm import decontaminate as module
from namesake.llm.decontaminate import decontaminate, report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(ASCII))


def brute(docs, items):
    where = lambda w, v: [i for i in range(len(w) - len(v) + 1) if w[i] == v[0] and w[i : i + len(v)] == v]
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(13, len(v))
            for a in range(len(v) - k + 1 if k else 0):
                for i in where(w, v[a : a + k]):
                    hit |= set(range(i, i + k))
                    ids.add(str(item))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "3,5"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 20, 13, 5, 2, 14])] + [(9, ""), (10, None), (11, "..."), (12, text(20))]
    items.append((13, items[0][1]))
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(50, items[0][1].upper() + "! " + text(5)), (51, text(300) + "\n" + items[1][1].replace(" ", "--") + text(3)), (52, None), (53, ""), (None, items[2][1])]
    docs += [(54, items[0][1]), (54, items[0][1]), (54, text(5)), (55, "x " * 20_000 + items[5][1])]
    return docs, items


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(module, "BROADCAST_WINDOWS", bound)
    docs, items = fixture()
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in report(d, b).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_actions(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    bad = {(r[0], r[1]) for r in brute(docs, items) if r[5]}
    left = decontaminate(d, b)
    assert left.columns == d.columns
    assert left.count() == sum((i, len(words(t))) not in bad for i, t in docs)
    cut = decontaminate(d, b, "spans")
    assert cut.count() == len(docs)
    hit = {(r[0], r[1]): r[2] for r in brute(docs, items)}
    want = sorted(((i, n - hit[i, n]) for i, t in docs for n in [len(words(t))]), key=str)
    assert sorted(((r.doc_id, len(words(r.text))) for r in cut.collect()), key=str) == want
    assert any(r.text.split() == ["x"] * 20_000 for r in cut.collect() if r.doc_id == 55)


def test_empty_tables(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert report(d.limit(0), b).count() == 0
    assert {r.n_hit for r in report(d, b.limit(0)).collect()} == {0}


def test_items_without_an_id(spark):
    docs = [(1, "one two three four"), (2, "five six seven"), (None, "one two three four five six"), (4, "clean")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(None, "two three four"), (7, "five six"), (None, "six")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in report(d, b).collect()}
    none, seven = (hashlib.sha256(x).hexdigest() for x in (b"", b"7"))
    assert got == {1: (4, 3, 0, none, True), 2: (3, 2, 1, seven, True), None: (6, 5, 1, seven, True), 4: (1, 0, 0, none, False)}
    assert [r.doc_id for r in decontaminate(d, b).collect()] == [4]
    assert sorted(r.text.strip() for r in decontaminate(d, b, "spans").collect()) == ["clean", "one", "one", "seven"]


def test_a_contaminated_text_meets_its_words_once(spark, monkeypatch):
    """The rows that are written and joined are as many as the documents, however many of their windows are hit."""
    written = []
    keep = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: written.append(keep(df)) or written[-1])
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    d = spark.createDataFrame([(1, text), (2, text), (2, text), (3, "other words"), (4, f"{text} {text}")], "doc_id long, text string")
    b = spark.createDataFrame([(9, text)], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in report(d, b).collect())
    assert got == [(1, 3000, 3000, 1), (2, 3000, 3000, 1), (2, 3000, 3000, 1), (3, 2, 0, 0), (4, 6000, 6000, 1)]
    counted = next(df for df in written if "hits" in df.columns)
    assert sorted((r.doc_id, r.copies, len(r.hits)) for r in counted.collect()) == [(1, 1, 2988), (2, 2, 2988), (3, 1, 0), (4, 1, 5976)]


def test_just_one_in_twenty(spark):
    item = " ".join(f"x{i}" for i in range(13))
    d = spark.createDataFrame([(1, item + " y" * 247), (2, item + " y" * 248)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in report(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (260, 13, True), 2: (261, 13, False)}
