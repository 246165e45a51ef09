import random

from namesake.llm.language_id import SEGMENT, Automaton, Identifier, identify, keep_identified, labelled_sample
from pyspark.sql import functions as F

import numpy as np

WORDS = {"en": "the and of that with house water think would".split(), "de": "der und nicht über straße wasser mädchen für".split(), "fr": "les être où français château eau mère pour".split()}


def sentence(lang, rng, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_phrases_match_brute_force():
    rng = random.Random(5)
    source = [rng.randint(1, 4) for _ in range(300)]
    automaton = Automaton(source)
    text = bytes(source)
    for _ in range(50):
        line = [rng.randint(1, 5) for _ in range(40)]
        count, at = 0, 0
        while at < len(line):
            n = 1
            while at + n < len(line) and bytes(line[at : at + n + 1]) in text and bytes(line[at : at + n]) in text:
                n += 1
            count, at = count + 1, at + n
        assert automaton.phrases(np.array(line, np.int32)[:, None], np.zeros(1, bool))[0] == count


def test_languages(spark):
    rng = random.Random(4)
    docs = [(i, sentence(lang, rng), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    docs += [(500, None, "en"), (501, "", "de"), (502, "123 ... 漢", None), (503, "12 !?", None), (None, sentence("fr", rng), None), (504, sentence("de", rng, 5000), None), (504, sentence("de", rng, 5000), None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    sample = labelled_sample(frame, F.col("doc_id") % 2 == 0, 10)
    assert set(sample) == {"en", "de", "fr"} and all(len(x) <= 10 * 201 for x in sample.values())
    got = identify(frame, sample).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang in docs[:120])
    assert all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (500, 501, 503)] == ["und"] * 3 and by_id[502].lang_pred != "und"
    assert by_id[None].lang_pred == "fr" and by_id[504].lang_pred == "de"


def test_nothing_learned_and_empty(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    sample = labelled_sample(frame, F.lit(True))
    assert sample == {} and identify(frame, sample).first().lang_pred == "und"
    assert identify(frame.limit(0), {"en": "abc"}).count() == 0


def test_phrases_run_on_over_segments():
    """Segments parsed side by side against one parse of the whole text, with matches longer than segments too."""
    rng = random.Random(9)
    source = [rng.randint(1, 4) for _ in range(3000)]
    automaton = Automaton(source)
    texts, columns, follows = [], [], []
    for _ in range(40):
        line = []
        while len(line) < rng.randint(1, 6 * SEGMENT):
            a = rng.randrange(3000)
            line += rng.choice([source[a : a + rng.choice([3, 20, 1500])], [rng.randint(1, 5)]])
        texts.append(line)
        for at in range(0, len(line), SEGMENT):
            part = line[at : at + SEGMENT]
            columns.append(part + [0] * (SEGMENT - len(part)))
            follows.append(at > 0)
    got = automaton.phrases(np.array(columns, np.int32).T.copy(), np.array(follows))
    k = 0
    for line in texts:
        parts = -(-len(line) // SEGMENT)
        whole = automaton._run(np.array(line, np.int32)[:, None], np.zeros(1, np.int32), count := np.zeros(1, np.int32))
        assert len(whole) == 1 and got[k : k + parts].sum() - (parts * SEGMENT - len(line)) == count[0]
        k += parts


def test_equal_languages_take_the_first_name(spark):
    frame = spark.createDataFrame([(1, "the house of water", "x"), (1, "the house of water", "x")], "doc_id long, text string, lang_pred string")
    got = identify(frame, {"b": "the house of water", "a": "the house of water"}).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("a", 0.0)] * 2


def test_rows_are_kept_by_their_own_text(spark):
    rows = [(1, "the house", "a"), (1, "12", "b"), (None, "34", "c"), (None, "the water", "d"), (2, None, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    left = keep_identified(frame, {"en": "the house of water"})
    assert left.columns == frame.columns and sorted(r.score for r in left.collect()) == ["a", "d"]
    assert keep_identified(frame.limit(0), {"en": "abc"}).count() == 0 and keep_identified(frame, {}).count() == 0


def alphabet(first, n):
    return [c for c in map(chr, range(first, first + n)) if c.isalpha()]


SCRIPTS = {"el": alphabet(0x3B1, 25), "en": alphabet(0x61, 26), "gothic": alphabet(0x10330, 20), "ja": alphabet(0x3041, 80), "ko": alphabet(0xAC00, 2000), "ru": alphabet(0x430, 32), "zh": alphabet(0x4E00, 3000)}


def test_many_scripts():
    rng = random.Random(8)
    line = lambda lang, n: "".join(rng.choice(SCRIPTS[lang]) + rng.choice(["", "", " "]) for _ in range(n))
    model = Identifier({x: line(x, 9000) for x in SCRIPTS})
    for lang in SCRIPTS:
        langs, scores = model.identify([line(lang, 60) for _ in range(10)])
        assert langs == [lang] * 10 and min(scores) > 0.01, lang


def test_phrases_over_a_large_alphabet_match_brute_force():
    rng = random.Random(6)
    source = [rng.randint(1, 90) for _ in range(3000)]
    automaton = Automaton(source)
    assert automaton.keys is not None
    runs = {tuple(source[a : a + n]) for n in range(1, 42) for a in range(len(source) - n + 1)}
    for _ in range(30):
        line = []
        while len(line) < 40:
            a = rng.randrange(3000)
            line += [*source[a : a + rng.randint(1, 6)], *[rng.randint(1, 99)] * rng.randint(0, 1)]
        line = line[:40]
        count, at = 0, 0
        while at < len(line):
            n = 1
            while at + n < len(line) and tuple(line[at : at + n + 1]) in runs:
                n += 1
            count, at = count + 1, at + n
        assert automaton.phrases(np.array(line, np.int32)[:, None], np.zeros(1, bool))[0] == count


def test_work_on_long_runs_grows_with_their_length(monkeypatch):
    """A run of one character, whose segments never fall in step: steps over symbols are counted, not seconds."""
    source = Identifier({"a": "aaa ab ba aab abba b a" * 20}).automata[0]
    assert source.width < 64
    steps = {"side by side": 0, "in order": 0}
    run, walk = Automaton._run, Automaton._walk

    def counted_run(self, rows, state, count):
        steps["side by side"] += rows.size
        return run(self, rows, state, count)

    def counted_walk(self, symbols, state):
        steps["in order"] += len(symbols)
        return walk(self, symbols, state)

    monkeypatch.setattr(Automaton, "_run", counted_run)
    monkeypatch.setattr(Automaton, "_walk", counted_walk)
    took = []
    for segments in (200, 400):
        steps.update({"side by side": 0, "in order": 0})
        columns = np.full((SEGMENT, segments), 2, np.int32)
        got = source.phrases(columns, np.arange(segments) > 0)
        whole = run(source, columns.T.reshape(-1, 1), np.zeros(1, np.int32), count := np.zeros(1, np.int32))
        assert len(whole) == 1 and got.sum() == count[0]
        took.append(dict(steps))
    assert took[1]["side by side"] <= 2.1 * took[0]["side by side"] <= 2.1 * 6 * 200 * SEGMENT
    assert took[0]["in order"] == took[1]["in order"] <= 8 * SEGMENT  # equal segments are looked up


def test_segments_that_never_fall_in_step():
    """Against one parse of the whole text, for tables and for sorted keys, with runs among other text."""
    rng = random.Random(3)
    for letters in (4, 90):
        source = [rng.randint(1, letters) for _ in range(2000)] + [2] * 7 + [3, 2, 3, 2, 3]
        automaton = Automaton(source)
        line = [rng.randint(1, letters + 1) for _ in range(700)] + [2] * (40 * SEGMENT) + [3, 2] * (20 * SEGMENT) + [rng.randint(1, letters) for _ in range(500)]
        line += [1] * (-len(line) % SEGMENT)
        columns = np.array(line, np.int32).reshape(-1, SEGMENT).T.copy()
        got = automaton.phrases(columns, np.arange(columns.shape[1]) > 0)
        automaton._run(np.array(line, np.int32)[:, None], np.zeros(1, np.int32), count := np.zeros(1, np.int32))
        assert got.sum() == count[0]


def test_a_long_run_of_one_character(spark):
    frame = spark.createDataFrame([(1, "a" * 1_000_000), (2, "the house")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in identify(frame, {"en": "the house aa of water", "xx": "a" * 50}).collect()}
    assert got == {1: "xx", 2: "en"}
