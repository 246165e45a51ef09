"""CSV and back, keyword groups as a table, Jaro-Winkler in Arrow batches."""

import datetime
import random

from pyspark.sql import functions as F

from namesake.functions import strings
from namesake.operators.pairs import jaro_winkler_batches, keyword_matches
from namesake.schema import ARTICLE
from namesake.sources.files import read_csv, write_csv


def test_articles_through_csv(spark, tmp_path):
    author = ("Ann", "Lee", "AL", 'Uni "X", line\nbreak\r\nand more', "0000", "Ann B")
    rows = [
        (1, '=HYPERLINK("x")', "J, of \"things\"", ["1234-5678", "=1"], 2001, "-2001", datetime.date(2001, 2, 3), [author, author], [("Mice", ["q"], True), ("Rats", [], False)], ["k"], [], ["Review"], "10.1/x", " spaces and\ttabs "),
        (2, "'=quoted", "'plain", [], 0, "", None, [], [], [], [], [], "", "+1"),
        (3, "''-x", "'", None, -5, None, None, None, [(None, None, None)], [None, ""], [], [], None, "\r\n"),
    ]
    df = spark.createDataFrame(rows, ARTICLE)
    write_csv(df, str(tmp_path / "a"))
    back = read_csv(spark, str(tmp_path / "a"), ARTICLE)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(back.collect()) == sorted(df.collect())
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("*.csv"))
    assert "\"'=HYPERLINK(" in text and text.startswith('"pmid","title"')
    write_csv(df.limit(0), str(tmp_path / "e"))
    assert read_csv(spark, str(tmp_path / "e"), ARTICLE).count() == 0


def test_keyword_groups_as_a_table(spark):
    """Against the fold over groups: random words in random texts, words of one and two letters too."""
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [letters(rng.randint(0, 30)).upper() for _ in range(300)] + ["", None, "ab"] * 2
    groups = ["|".join(letters(rng.randint(1, 5)).strip() or "b" for _ in range(rng.randint(1, 3))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([(str(i), w) for i, g in enumerate(groups) for w in g.split("|")], "group string, word string")
    for some in (groups, groups[:1]):
        words = table.filter(F.col("group").cast("int") < len(some))
        got = {r.id: r.hit for r in keyword_matches(rows, "text", words, "hit").collect()}
        want = {r.id: r.hit for r in rows.select("id", F.coalesce(strings.keyword_match(F.col("text"), some), F.lit(False)).alias("hit")).collect()}
        assert got == want
    assert 0 < sum(want.values()) < len(want)


def test_a_thousand_groups_plan_small(spark):
    table = spark.range(1000).selectExpr("cast(id as string) as group", "concat('word', id) as word")
    plan = keyword_matches(spark.createDataFrame([(1, "has word77 x")], "id long, text string"), "text", table, "hit")
    assert plan.first().hit and len(plan._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_jaro_winkler_in_batches(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(10_000)] + [("martha", "marhta"), ("dixon", "dicksonx"), ("", ""), ("a", ""), ("x" * 80, "x" * 79 + "y")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, a string, b string")
    fold = rows.withColumn("s", strings.jaro_winkler(F.col("a"), F.col("b")))
    want, got = ({r.id: r.s for r in df.collect()} for df in (fold, jaro_winkler_batches(rows, "a", "b", "s")))
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want)
