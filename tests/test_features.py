"""Hand-made persons and articles, one per rule."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from namesake.functions import numbers, strings
from namesake.operators import feedback, identity_features, target
from namesake.operators.order import CLEANUP, written
from namesake.params import Params, degree_year_score
from namesake.plans.catalogue import _resolved
from namesake.plans.fixtures import Tables

AUTHORS = "array<struct<first_name:string,last_name:string,initials:string,affiliation:string,orcid:string,fore_name:string>>"


def candidate(spark, rows):
    """rows: (first, middle, last, e-mail, [(first, last, initials, affiliation)])."""
    data = [
        (str(i), i, f, m, l, e, [(a[0].split(" ")[0] if a[0] else "", a[1], a[2], a[3], "", a[0]) for a in authors], "Northfield University", "Surgery", "", 2000, 0, 0, "", "J", 2005, ["K"])
        for i, (f, m, l, e, authors) in enumerate(rows)
    ]
    schema = f"person_id string, pmid long, first_name string, middle_name string, last_name string, primary_email string, authors {AUTHORS}, primary_institution string, department string, orcid string, bachelor_year int, doctoral_year int, n int, assertion string, journal string, pub_year int, keywords array<string>"
    return spark.createDataFrame(data, schema)


A = lambda first, last, initials="", affiliation="": (first, last, initials, affiliation)
OTHER = A("Zed", "Quux", "Z")
CASES = [
    (("Paul", "", "Albert", "", [OTHER, A("Paul", "Albert", "P")]), 1),  # first and last
    (("Paul", "Jay", "Albert", "", [A("Paul", "Albert", "PK"), A("Paul", "Albert", "PJ")]), 1),  # middle initial
    (("Paul", "", "Albert", "", [OTHER, A("Pau", "Albert")]), 1),  # part of the name
    (("Paul", "", "Albert", "", [OTHER, A("Pauline", "Albert")]), 1),
    (("Paul", "", "Albert", "", [OTHER, A("P", "Albert", "P")]), 1),  # initial
    (("Paul", "", "Xyz", "paa@med.edu", [OTHER, A("M", "N", "", "x, paa@med.edu"), A("M", "O", "", "paa@med.edu")]), 1),  # address
    (("Paul", "William", "Albert", "", [OTHER, A("William", "Albert", "WP")]), 1),  # swapped initials
    (("Paul", "", "Albert", "", [OTHER, A("Peter", "Albertson", "P")]), 1),  # last name inside
    (("Paul", "", "Albert", "", [OTHER, A("Karl", "Albert", "K")]), 1),  # last name only
    (("Paul", "", "Albert", "", [OTHER, A("Paul", "Nnn", "P")]), 1),  # first name only
    (("Paul", "", "Albertson", "", [OTHER, A("Karl", "Alber", "K")]), 1),
    (("Paul", "Meyer", "Albert", "", [OTHER, A("Pia", "Meyer", "P")]), 1),  # middle as last name
    (("Paul", "", "Albert", "", [OTHER, A("Albert", "Paul", "A")]), 1),  # swapped names
    (("Robert", "", "Smith", "", [OTHER, A("Rob", "Smyth", "R")]), 1),  # a letter off: both initials come first
    (("Robert", "", "Smith", "", [A("Robert", "Nowak", "R"), A("Robert", "Pmith", "R"), A("Robert", "Other", "R")]), 1),  # two letters off
    (("Paul", "", "Albert", "", [OTHER]), -1),
    (("Paul", "", "Albert", "", []), -1),
]


def test_cascade(spark):
    rows = target.resolve_target_author(candidate(spark, [c for c, _ in CASES])).select("pmid", "target_author_index").collect()
    assert {r.pmid: r.target_author_index for r in rows} == dict(enumerate(w for _, w in CASES))


def test_both_forms_of_the_cascade(spark):
    """The form over arrays against the one over groups: random short names, so that all rules and ties come up."""
    rng = random.Random(7)
    name = lambda: rng.choice(["ann", "an", "a", "lee", "le", "leex", "bo", "", "mcle", "anna lee"])
    author = lambda: A(name(), name(), rng.choice(["", "A", "AL", "LA"]), rng.choice(["", "x user1@m.org", "y"]))
    cases = [(name(), name(), name(), rng.choice(["", "user1@m.org"]), [author() for _ in range(rng.randint(0, 5))]) for _ in range(1500)]
    rows = candidate(spark, cases)
    for whole in (False, True):
        one = {r.pmid: r.target_author_index for r in target.resolve_target_author(rows, whole).collect()}
        two = {r.pmid: r.target_author_index for r in target.resolve_by_groups(rows, whole).collect()}
        assert one == two and len(one) == 1500 and len(set(one.values())) == 6


def test_whole_given_names(spark):
    rows = candidate(spark, [("Paul", "Jay", "Albert", "", [A("Paul Jim", "Albert"), A("Paul Jay", "Albert")])])
    assert target.resolve_target_author(rows, fore_name=True).first().target_author_index == 1


@pytest.mark.parametrize(
    "own, article, score",
    [("Robert", "Robert", 1.852), ("Robert", "R", 0.441), ("R", "Robert", 0.441), ("Robert", "Alice", -3.087), ("Robert", "Richard", -2.646), ("Robert", "Robet", -0.75), ("Robert", "Robina", -0.75), ("Robert", "", -1.941)],
)
def test_first_names(spark, own, article, score):
    rows = candidate(spark, [(own, "", "Smith", "", [A(article, "Smith", "R" if article else "")])]).withColumn("target_author_index", F.lit(0))
    got = identity_features.add_name_scores(target.with_target(rows)).first()
    assert got.nameMatchFirstScore == score and got.nameMatchLastScore == 0.664


def test_names_without_target_and_suffixes(spark):
    rows = candidate(spark, [("Robert", "J", "Smith", "", [A("Robert", "Smith, Jr.", "RJ")]), ("Robert", "", "Jones", "", [A("X", "Y", "X")])])
    rows = rows.withColumn("target_author_index", F.when(F.col("pmid") == 0, 0).otherwise(-1))
    got = {r.pmid: r for r in identity_features.add_name_scores(target.with_target(rows)).collect()}
    assert (got[0].nameMatchLastScore, got[0].nameMatchMiddleScore) == (0.664, 1.191)
    assert (got[1].nameMatchFirstScore, got[1].nameMatchLastScore, got[1].nameMatchMiddleScore, got[1].nameMatchModifierScore) == (-1.323, -0.996, -1.588, 0.0)


def test_addresses(spark):
    texts = ["Surgery, Northfield University", "University of Northfield", "Elsewhere", "", "harbor medical northfield", "x@med.northfield.edu"]
    rows = candidate(spark, [("A", "", "B", "qq77@x.org", [A("A", "B", "A", t)]) for t in texts]).withColumn("target_author_index", F.lit(0))
    site = Params(email_suffixes=["@med.northfield.edu"], home_keywords=["harbor|northfield"], synonyms={"surgery": ["operations"]})
    got = {r.pmid: r for r in identity_features.add_address_scores(target.with_target(rows), site).collect()}
    assert [got[i].targetAuthorInstitutionalAffiliationMatchTypeScore for i in range(6)] == [1.0, 1.0, -0.8, 0.0, 1.8, 1.8]
    assert [got[i].organizationalUnitMatchingScore for i in range(2)] == [0.6, 0.0]
    assert [got[i].emailMatchScore for i in (0, 3)] == [-1.0, 0.0]


def test_lookups(spark):
    rows = candidate(spark, [("Anna", "", "B", "", [A("Anna", "B")]), ("Anna", "", "B", "", [A("Karl", "B")]), ("Xx", "", "B", "", [A("Karl", "B")])]).withColumn("target_author_index", F.lit(0))
    rows = target.with_target(rows.withColumn("journal_issn", F.array(F.lit("0000-0000"), F.lit("1234-567X"))))
    genders = spark.createDataFrame([("anna", "f", 0.9), ("karl", "m", 0.8)], "name string, gender string, probability double")
    issn = spark.createDataFrame([("1234567x", "Surgery & Co")], "issn string, subfield string")
    departments = spark.createDataFrame([("Surgery", "Surgery & Co")], "department string, subfield string")
    got = {r.pmid: r for r in identity_features.add_lookup_scores(rows, departments, genders, issn).collect()}
    assert [round(got[i].genderScoreIdentityArticleDiscrepancy, 3) for i in range(3)] == [round(-1.36 + 1.6 * 0.9, 3), round(-1.36 + 1.6 * 0.2, 3), 0.0]
    assert got[0].journalSubfieldScore == 0.47 and got[0].journalSubField == "Surgery & Co"


def test_degree_years():
    assert [degree_year_score(d) for d in (-200, -99, -13, -12, -1, 0, 4, 5, 8, 9, 11, 12, 47, 48, 100, 200)] == [-12.6, -12.6, -4.0, -3.78, -1.36, -1.16, -0.36, -0.175, 0.38, 0.55, 0.89, 0.9, 0.9, 0.89, -1.61, -1.61]


def test_feedback_kernel(spark):
    grid = spark.range(20).select(F.col("id").alias("a")).join(spark.range(20).select(F.col("id").alias("r")))
    for row in grid.select("a", "r", feedback.sigmoid(F.col("a"), F.col("r")).alias("s")).collect():
        assert -0.5 < row.s < 0.5 and (row.s > 0) == (row.a > row.r) and (row.s < 0) == (row.a < row.r)
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    kernel = lambda mark, strict: value(feedback.decided(F.lit(mark), F.lit(5), F.lit(2), strict))
    assert kernel("ACCEPTED", False) < kernel("", False) < kernel("REJECTED", False) and kernel("ACCEPTED", True) == kernel("", False)
    assert value(feedback.absence(F.lit(20), F.lit(0.7))) < value(feedback.absence(F.lit(2), F.lit(0.7))) < 0 == value(feedback.absence(F.lit(0), F.lit(0.7)))


def brute_jaro_winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == c and j not in used), None)
        if j is not None:
            used.add(j)
            left.append(c)
    if not left:
        return 0.0
    off = sum(x != b[j] for x, j in zip(left, sorted(used))) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - off) / m) / 3
    same = 0
    while same < 4 and a[same : same + 1] == b[same : same + 1] and a[same : same + 1]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


def test_jaro_winkler(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))
    pairs = [(word(), word()) for _ in range(400)] + [("martha", "marhta"), ("dixon", "dicksonx"), ("", ""), ("", "a"), ("a", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("s", strings.jaro_winkler(F.col("a"), F.col("b"))).collect()
    assert all(abs(r.s - brute_jaro_winkler(r.a, r.b)) < 1e-9 for r in rows)


def test_strings(spark):
    row = spark.createDataFrame([("O'Neil-Roy ", "https://orcid.org/0000-0001", "a@B.edu", "Harbor Northfield Medical College of New York", "2003 Jan-Feb", "=1+1")], "n string, o string, e string, i string, y string, x string")
    c = F.col
    got = row.select(
        strings.name_key(c("n")), strings.score_key(c("n")), strings.normalize_orcid(c("o")), strings.email_user(c("e")), strings.email_domain(c("e")),
        strings.keywords_of(c("i")), strings.year_in(c("y")), strings.guard_cell(c("x")), strings.domain_in(F.lit("Mail: x.y@Med.edu, USA")), strings.strip_suffixes(F.lit("Smith MD PhD, Jr")),
    ).first()
    assert tuple(got) == ("oneilroy", "oneil roy", "0000-0001", "a", "b.edu", "harbor|northfield|medical|new", 2003, "'=1+1", "med.edu", "Smith")
    bounds = spark.createDataFrame([(0, 0), (100, 0), (0, 100), (4, 1)], "a int, r int").select(strings.wilson_clipped(c("a"), c("r")).alias("w"), strings.wilson(c("a"), c("r")).alias("v")).collect()
    assert bounds[0].w == 0.5 and bounds[0].v == 0.0 and bounds[1].w > 0.95 and bounds[2].w < 0.05 and 0.3 < bounds[3].w < 0.5


def test_facts_of_feedback_are_exchanged_once(spark):
    """By person, dimension and value; then only the sums of person and article move, and meet the rows that ask for them."""
    cand = written(_resolved(Tables(spark, "/root/testdata/sf0.001")))
    plan = feedback.feedback_features(cand)._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    facts = [keys for keys in by if "dim#" in keys]
    assert len(facts) == 1 and "value#" in facts[0] and len(by) <= 4


def test_author_keys_of_odd_names(spark):
    """Names of white space, of marks alone, with several words or none: the same author by both forms of the cascade."""
    names = ["", " ", "-", "Mary Ann", " Mary", "J.-P.", "- x", "Li", "O'Neil Jo", None]
    author = lambda n: (n, "Stone", "JP", "", "", n)
    data = [(f"p{i}", i, p, "Stone", m, "", [author(n) for n in names if n != p] + [author(p)]) for i, (p, m) in enumerate((p, m) for p in names if p is not None for m in ("", "Ann"))]
    cand = spark.createDataFrame(data, f"person_id string, pmid long, first_name string, last_name string, middle_name string, primary_email string, authors {AUTHORS}")
    for whole in (False, True):
        rows = {r.pmid: r.target_author_index for r in target.resolve_target_author(cand, whole).collect()}
        assert rows == {r.pmid: r.target_author_index for r in target.resolve_by_groups(cand, whole).collect()}
        assert len(rows) == len(data) and any(v >= 0 for v in rows.values())


def test_mirrored_scores_cancel_as_in_c(spark):
    """One accepted and four rejected against four and one, and others: by the C library the sums of some are 5e-17, by Java's exp 0."""
    def own(a, r):
        return 1 / (1 + math.exp(-(a - r) / (math.sqrt(a + r) + 1))) - 0.5

    pairs = [(a, r) for a in range(13) for r in range(a)]
    rows = spark.createDataFrame(pairs, "a long, r long")
    got = rows.select("a", "r", feedback.sigmoid(F.col("a"), F.col("r")).alias("x"), feedback.sigmoid(F.col("r"), F.col("a")).alias("y")).collect()
    assert {(g.a, g.r): (g.x, g.y) for g in got} == {(a, r): (own(a, r), own(r, a)) for a, r in pairs}
    one = next(g for g in got if (g.a, g.r) == (4, 1))
    assert one.x + one.y != 0


def test_exp(spark):
    values = [-750.0, -700.0, -699.9, -3.7, -1.0, -1e-300, 0.0, 0.3, 1.0, 2.5, 690.0, 800.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", numbers.exp(F.col("v")).alias("e")).collect()
    assert all(g.e == (math.exp(g.v) if g.v < 700 else math.inf) or abs(g.e / math.exp(g.v) - 1) < 3e-16 for g in got)


def test_facts_that_no_decision_shares_stay_behind(spark):
    """Only shared facts go on to the articles, as rows of one value each, and give the scores that all of them gave."""
    cand = written(feedback.needed(_resolved(Tables(spark, "/root/testdata/sf0.001"))))
    got = feedback.feedback_features(cand)
    plan = got._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION" in line]
    assert len(sent) == 2 and not any("sum" in line for line in sent)
    facts = feedback.evidence(cand).select("person_id", "pmid", "dim", "value", "assertion").collect()
    marks = {}
    for f in facts:
        marks.setdefault((f.person_id, f.dim, f.value), []).append((f.pmid, f.assertion))
    shared = {(f.person_id, f.pmid) for f in facts if f.dim == "Journal" and any(a and p != f.pmid for p, a in marks[f.person_id, f.dim, f.value])}
    decided = {f.person_id for f in facts if f.assertion == "ACCEPTED"}
    for r in got.collect():
        if r.person_id in decided and (r.person_id, r.pmid) not in shared:
            assert r.feedbackScoreJournal < 0


def test_written_frees_what_was_shuffled(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}

    before = files()
    rows = written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == "false"
    assert rows.count() == 7


def test_sums_do_not_depend_on_the_order(spark):
    """Scores that cancel but for 5e-17, of which orders that pass .5 lose the rest: one article against its fellows' keywords."""
    wanted = {"a": (1, 0), "b": (1, 0), "c": (1, 0), "d": (2, 0), "e": (0, 1), "f": (0, 1), "g": (0, 1), "h": (0, 2)}
    data = [("p", 0, "", list(wanted))]
    for k, (yes, no) in wanted.items():
        data += [("p", len(data) + i, mark, [k]) for i, mark in enumerate(["ACCEPTED"] * yes + ["REJECTED"] * no)]
    got = []
    for order in (list(wanted), list(wanted)[::-1], list("aebfcgdh")):
        rows = spark.createDataFrame([("p", 0, "", order), *data[1:]], "person_id string, pmid long, assertion string, keywords array<string>")
        author = F.struct(*[F.lit("").alias(c) for c in ("first_name", "last_name", "orcid", "affiliation")])
        cand = rows.select("*", F.array().cast(AUTHORS).alias("authors"), author.alias("target"), F.lit(-1).alias("target_author_index"), F.lit("").alias("journal"), F.lit(0).alias("pub_year"), F.lit("x").alias("department"))
        got.append(feedback.feedback_features(cand, dims=["Keyword"]).filter("pmid = 0").first().feedbackScoreKeyword)
    score = lambda a, r: 1 / (1 + math.exp(-(a - r) / (math.sqrt(a + r) + 1))) - 0.5
    assert set(got) == {math.fsum(score(*v) for v in wanted.values())} and got[0] != 0
