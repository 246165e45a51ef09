"""Readers, merges, retrieval, evaluation and the update stream."""

import random

import pytest
from pyspark.sql import functions as F

from namesake import schema
from namesake.operators import discover, evaluate, reports, retrieve
from namesake.params import Params
from namesake.plans.fixtures import Tables
from namesake.schema import ARTICLE
from namesake.sources import readers, tables
from namesake.streaming.incremental import incremental_update


def test_headers():
    assert readers.detect_mappings(["Emp ID", "FName", "last-name", "PhD Year", "rank", "favorite_color", "uid"]) == {"Emp ID": "person_id", "FName": "first_name", "last-name": "last_name", "PhD Year": "doctoral_year", "rank": "title"}


def test_roster_and_list(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("uid\tfirst name\tLast Name\tphd year\tpmid\tstatus\n1\tAnn\tLee\t1999\t123.0\taccepted\n1\tAnn\tLee\t1999\t124\tmaybe\n2\t\tX\t\t5\tREJECTED\n3\tBo\tYe\t\t\t\n")
    roster = readers.read_roster(spark, str(tmp_path / "r.tsv"))
    people, marks = readers.split_roster(roster)
    assert sorted((r.person_id, r.doctoral_year, r.primary_email) for r in people.collect()) == [("1", 1999, ""), ("3", 0, "")]
    assert [tuple(r) for r in marks.collect()] == [("1", 123, "ACCEPTED")]
    (tmp_path / "p.csv").write_text("person_id,pmid,assertion\n1, 7 ,rejected\n2,x,ACCEPTED\n2,8,\n")
    assert sorted(map(tuple, readers.read_pmid_list(spark, str(tmp_path / "p.csv")).collect())) == [("1", 7, "REJECTED"), ("2", 8, "")]


XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article><Journal><ISSN IssnType="Print">1234-5678</ISSN>
<JournalIssue><PubDate><MedlineDate>2003 Jan-Feb</MedlineDate></PubDate></JournalIssue><Title>J. of X</Title></Journal><ArticleTitle>On things</ArticleTitle>
<ELocationID EIdType="pii">p1</ELocationID><ELocationID EIdType="doi">10.1/a</ELocationID><ELocationID EIdType="doi">10.1/b</ELocationID>
<Abstract><AbstractText>First.</AbstractText><AbstractText>Second.</AbstractText></Abstract>
<AuthorList><Author><LastName>Lee</LastName><ForeName>Ann B</ForeName><Initials>AB</Initials><AffiliationInfo><Affiliation>Uni</Affiliation></AffiliationInfo>
<Identifier Source="ORCID">https://orcid.org/0000-0001-0000-0002</Identifier></Author><Author><LastName>Ye</LastName></Author></AuthorList>
<PublicationTypeList><PublicationType UI="D1">Review</PublicationType></PublicationTypeList><GrantList><Grant><GrantID>G1</GrantID></Grant></GrantList></Article>
<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="N">Mice</DescriptorName><QualifierName MajorTopicYN="Y">genetics</QualifierName></MeshHeading>
<MeshHeading><DescriptorName MajorTopicYN="N">Rats</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword MajorTopicYN="N">key</Keyword></KeywordList></MedlineCitation>
<PubmedData><History><PubMedPubDate PubStatus="entrez"><Year>2004</Year><Month>2</Month><Day>3</Day></PubMedPubDate></History></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>78</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = readers.read_articles(spark, str(tmp_path / "a.xml")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.pmid, r.pub_year, r.doi, r.abstract, r.journal_issn, r.keywords, r.grants, r.publication_types, str(r.entry_date)) == (77, 2003, "10.1/b", "First.", ["1234-5678"], ["key"], ["G1"], ["Review"], "2004-02-03")
    assert (r.authors[0].first_name, r.authors[0].fore_name, r.authors[0].orcid, r.authors[1].first_name) == ("Ann", "Ann B", "0000-0001-0000-0002", "")
    assert [(m.descriptor_name, m.major_topic) for m in r.mesh] == [("Mice", True), ("Rats", False)]


def test_lookups(spark, tmp_path):
    """Files in the forms that they come in; of equal keys the last entry counts."""
    (tmp_path / "n.json").write_text('{"ann": {"score": 1.5, "count": 3}, "bo": {"score": 2}, "ann": {"score": 7}}')
    (tmp_path / "g.json").write_text('[{"name": "Ann", "gender": "f", "probability": 0.9}, {"name": "", "gender": "m"}, {"name": "ANN", "gender": "m", "probability": "0.6"}, {"name": "Bo"}]')
    (tmp_path / "s.json").write_text('[{"issn": "1234-567X", "eissn": "", "scienceMetrixSubfield": "S"}, {"issn": "1111-1111", "eissn": "1234-567x", "scienceMetrixSubfield": "T"},\n{"issn": "2222-2222", "scienceMetrixSubfield": ""}]')
    (tmp_path / "d.json").write_text('[{"primaryDepartment": "Surgery", "scienceMetrixJournalSubfield": "S"}, {"primaryDepartment": "surgery", "scienceMetrixJournalSubfield": "T"}, {"primaryDepartment": "surgery", "scienceMetrixJournalSubfield": "T"}, {"primaryDepartment": "", "scienceMetrixJournalSubfield": "T"}]')
    got = readers.load_lookups(spark, {"name_frequency": str(tmp_path / "n.json"), "gender": str(tmp_path / "g.json"), "subfields": str(tmp_path / "s.json"), "departments": str(tmp_path / "d.json")})
    rows = {k: sorted(map(tuple, v.collect())) for k, v in got.items()}
    assert rows == {
        "name_frequency": [("ann", 7.0), ("bo", 2.0)],
        "gender": [("ann", "m", 0.6), ("bo", "", 0.0)],
        "subfields": [("11111111", "T"), ("1234567x", "T")],
        "departments": [("surgery", "S"), ("surgery", "T")],
    }
    (tmp_path / "x.json").write_text('[{"dept": "Surgery", "field": "S"}]')
    other = readers.load_lookups(spark, {"departments": str(tmp_path / "x.json")}, {"department": "dept", "department_subfield": "field"})
    assert [tuple(r) for r in other["departments"].collect()] == [("surgery", "S")]


def test_author_orcids(spark, tmp_path):
    """Of an address the last part, slashes at its end or not; anything else stays as it is."""
    ids = ["https://orcid.org/0000-0001-2345-6789/", "http://orcid.org/0000-0001-2345-678X", "0000-0002-1111-2222", "a/b", " https://orcid.org// "]
    authors = "".join(f'<Author><LastName>L</LastName><Identifier Source="ORCID">{i}</Identifier></Author>' for i in ids)
    (tmp_path / "o.xml").write_text(f"<S><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>t</ArticleTitle><AuthorList>{authors}</AuthorList></Article></MedlineCitation></PubmedArticle></S>")
    got = [a.orcid for a in readers.read_articles(spark, str(tmp_path / "o.xml")).first().authors]
    assert got == ["0000-0001-2345-6789", "0000-0001-2345-678X", "0000-0002-1111-2222", "a/b", "orcid.org"]


@pytest.mark.parametrize("first", ["a", "b"])
def test_last_row_wins_over_several_files(spark, tmp_path, first):
    """The file that comes later by name has the last word, whichever is larger; so has the later line of a split file."""
    many = {first: 4000}
    for name in ("a", "b"):
        rows = [f"{i},First,{name}{i}" for i in range(2, many.get(name, 10))] + [f"1,Ann,{name}-early", f"1,Ann,{name}-late"]
        (tmp_path / f"{name}.csv").write_text("\n".join(["uid,first name,last name", *rows]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        roster = readers.read_roster(spark, str(tmp_path))
        people, _ = readers.split_roster(roster.withColumns({"pmid": F.lit(""), "assertion": F.lit("")}))
        assert roster.rdd.getNumPartitions() > 2
        assert [r.last_name for r in people.filter("person_id = '1'").collect()] == ["b-late"]
        assert [r.last_name for r in tables.upsert_identities(people.limit(0), roster).filter("person_id = '1'").collect()] == ["b-late"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('person_id,first_name,last_name,title\n1,Ann,Lee,"Head of\nthings"\n2,Bo,Ye,"a ""b"" c"\n')
    got = sorted((r.person_id, r.title) for r in readers.read_roster(spark, str(tmp_path / "q.csv")).collect())
    assert got == [("1", "Head of\nthings"), ("2", 'a "b" c')]


def test_merge_order(spark):
    old = spark.createDataFrame([(1, "a", 9)], "k int, v string, extra int")
    new = spark.createDataFrame([(1, "b", 0), (1, "c", 1), (2, "d", 0), (2, "e", 1)], "k int, v string, pos int")
    assert sorted(map(tuple, tables.merge(old, new, ["k"], "overwrite", "pos").collect())) == [(1, "c", 9), (2, "e", None)]
    assert sorted(map(tuple, tables.merge(old, new, ["k"], "keep", "pos").collect())) == [(1, "a", 9), (2, "d", None)]
    empty, counts = tables.wipe({"a": old, "b": new})
    assert {r.table: r.deleted for r in counts.collect()} == {"a": 1, "b": 4} and empty["a"].count() == 0


def test_upserts(spark):
    links = spark.createDataFrame([("1", 1, "search"), ("1", 2, "upload")], schema.LINK.replace("target_author_index int, ", ""))
    pairs = spark.createDataFrame([("1", 1), ("1", 2), ("1", 2), ("2", 1)], "person_id string, pmid long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.link_uploads(links, pairs)) == [("1", 1, "search"), ("1", 2, "upload"), ("2", 1, "upload")]
    assert rows(tables.link_found(links, pairs)) == [("1", 1, "search"), ("1", 2, "search"), ("2", 1, "search")]
    old = spark.createDataFrame([("1", 1, "identityOnly", 0.1, 0.2, None, 1)], schema.SCORE)
    new = spark.createDataFrame([("1", 1, "identityOnly", 0.5, 0.6, None, 2), ("1", 1, "feedbackIdentity", 0.7, 0.8, None, 2)], schema.SCORE)
    new = new.withColumn("scored_at", F.to_timestamp(F.lit("2024-01-01")))
    assert {(r.model_type, r.calibrated_score, r.run_id) for r in tables.upsert_scores(old, new).collect()} == {("identityOnly", 0.5, 2), ("feedbackIdentity", 0.7, 2)}


def test_split_roster_takes_last_row(spark, tmp_path):
    (tmp_path / "r.csv").write_text("person_id,first_name,last_name,pmid,assertion\n1,Ann,Old,5,ACCEPTED\n1,Ann,New,6,REJECTED\n")
    people, marks = readers.split_roster(readers.read_roster(spark, str(tmp_path / "r.csv")))
    assert [r.last_name for r in people.collect()] == ["New"] and marks.count() == 2


def test_retrieval_log(spark):
    log = spark.createDataFrame([("1", "2020-01-01", "2019-01-01", 5, 1)], "person_id string, d string, o string, articles_found long, run_id long").selectExpr("person_id", "date(d) as last_retrieval_date", "date(o) as last_orcid_retrieval_date", "articles_found", "run_id")
    run = spark.createDataFrame([("1", "2021-01-01", 2, 2, False), ("2", "2021-01-01", 3, 2, True)], "person_id string, d string, articles_found long, run_id long, orcid_ran boolean").withColumn("retrieved_on", F.to_date("d"))
    got = {r.person_id: (str(r.last_retrieval_date), str(r.last_orcid_retrieval_date)) for r in tables.update_retrieval_log(log, run).collect()}
    assert got == {"1": ("2021-01-01", "2019-01-01"), "2": ("2021-01-01", "2021-01-01")}


def evaluation(spark, n=300):
    rng = random.Random(42)
    rows = [(str(i % 9), i, "m", round(rng.random() * 100, 1), rng.randint(0, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "person_id string, pmid long, model_type string, score double, label int")


def test_curves(spark):
    rows, df = evaluation(spark)
    pos, neg = [r[3] for r in rows if r[4]], [r[3] for r in rows if not r[4]]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(evaluate.roc_auc(df).first().auc - auc) < 1e-9
    ci = evaluate.bootstrap_ci(df, 300).first()
    assert ci.low < auc < ci.high and 0.05 < ci.high - ci.low < 0.25 and ci.resamples == 300
    assert evaluate.calibration(df).count() == 10 and evaluate.calibration(df.limit(0)).count() == 10
    d = evaluate.distribution(df).collect()
    assert sum(r.accepted for r in d) == len(pos) and sum(r.rejected for r in d) == len(neg)
    points = [(r.fpr, r.tpr) for r in evaluate.roc_points(df).orderBy("fpr", "tpr").collect()]
    assert points[0] == (0, 0) and points[-1] == (1, 1)
    assert evaluate.viability(df.limit(0)).first().status == "no_data" and evaluate.viability(df.filter("label = 1")).first().status == "single_class"


def test_full_report(spark):
    """Each part of the report against the same made of the rows by itself."""
    rng = random.Random(3)
    pairs = [(str(i % 7), i, rng.random(), rng.choice(["ACCEPTED", "REJECTED"])) for i in range(120)]
    score = spark.createDataFrame([(p, i, "feedbackIdentity", s) for p, i, s, _ in pairs], "person_id string, pmid long, model_type string, calibrated_score double")
    curation = spark.createDataFrame([(p, i, a) for p, i, _, a in pairs], "person_id string, pmid long, assertion string")
    identity = spark.createDataFrame([(str(k), "Ann", "Lee") for k in range(7)], "person_id string, first_name string, last_name string")
    got = evaluate.full_report(score, curation, identity)
    rows = evaluate.evaluation_set(score, curation)
    single = {"viability": evaluate.viability(rows), "roc_auc": evaluate.roc_auc(rows), "calibration": evaluate.calibration(rows), "average_precision": evaluate.average_precision(rows), "distribution": evaluate.distribution(rows)}
    values = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    assert set(got) == {"rows", "viability", "roc_points", "roc_auc", "bootstrap_ci", "calibration", "pr_curve", "average_precision", "distribution", "disagreements"}
    assert all(values(got[k]) == values(df) for k, df in single.items())
    positive = [s for _, _, s, a in pairs if a == "ACCEPTED"]
    negative = [s for _, _, s, a in pairs if a == "REJECTED"]
    area = sum(x > y for x in positive for y in negative) / (len(positive) * len(negative))
    ci = got["bootstrap_ci"].first()
    assert abs(got["roc_auc"].first().auc - area) < 1e-9 and ci.low < area < ci.high
    assert got["viability"].first().status == "viable" and got["roc_points"].count() == 121 and got["pr_curve"].count() == 121
    assert sorted(r.pmid for r in got["disagreements"].collect()) == sorted(i for _, i, s, a in pairs if abs(s * 100 - 100 * (a == "ACCEPTED")) >= 50)
    got["rows"].unpersist()


def test_orcids_from_decisions(spark):
    score = spark.createDataFrame([("1", i, "identityOnly", 0.1) for i in range(6)], "person_id string, pmid long, model_type string, calibrated_score double")
    resolved = spark.createDataFrame([("1", i, "A", "B", "0000-0001-1", ("https://orcid.org/0000-0001-1" if i else "0000-0009-9",)) for i in range(6)], "person_id string, pmid long, first_name string, last_name string, orcid string, target struct<orcid:string>")
    marks = spark.createDataFrame([("1", i, "ACCEPTED") for i in range(1, 5)] + [("1", 0, "REJECTED")], "person_id string, pmid long, assertion string")
    r = reports.infer_orcids(score, resolved, marks).first()
    assert (r.orcid, r.accepted_articles, r.confidence_tier, r.orcid_matches_identity) == ("0000-0001-1", 4, "likely", True)


def test_discovery(spark):
    text = spark.createDataFrame([("Department of Medicine, Fred Hutchinson Cancer Center, Seattle, WA, USA. a@fredhutch.org.",), ("Fred Hutchinson Cancer Center, b@FredHutch.org",)], "affiliation string")
    assert [tuple(r) for r in discover.email_domains(text).collect()] == [("fredhutch.org", 2)]
    names = discover.classify(discover.institution_names(text)).collect()
    assert (names[0].name, names[0].n, names[0].keywords, names[0].role) == ("Fred Hutchinson Cancer Center", 2, "fred|hutchinson|cancer", "home")


def test_modes_of_retrieval(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert retrieve.retrieve(t.identity, t.article, t.link, mode="score_only").count() == 0
    found = retrieve.retrieve(t.identity, t.article, t.link, cfg=Params(lenient_threshold=0, strict_threshold=0))
    assert found.count() == retrieve.retrieve_by_orcid(t.identity, retrieve.author_index(t.article)).join(t.link, ["person_id", "pmid"], "left_anti").count()


def test_update_stream(spark, tmp_path):
    person = spark.createDataFrame([("1", "Ann", "Lee", "")], "person_id string, first_name string, last_name string, orcid string")
    link = spark.createDataFrame([], "person_id string, pmid long")
    got = []

    def article(pmid, last):
        row = (pmid, "", "", [], 2000, "", None, [("Ann", last, "A", "", "", "Ann")], [], [], [], [], "", "")
        spark.createDataFrame([row], ARTICLE).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        q = incremental_update(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda: {"identity": person, "link": link}, lambda links, articles, n: got.extend(r.pmid for r in links.collect()))
        q.awaitTermination()

    article(1, "Lee")
    article(2, "Other")
    run()
    article(3, "Lee")
    run()
    assert sorted(got) == [1, 3]


@pytest.mark.parametrize("policy", ["overwrite", "keep"])
def test_merges_exchange_and_sort_once(spark, policy):
    """One sort holds both sides' rows, in parts whose number doesn't fall where the rows compress well."""
    old = spark.createDataFrame([("a", 1, 1.0, "x"), (None, 2, 2.0, "y")], "k string, n long, v double, kept string")
    new = spark.createDataFrame([("a", 1, 3.0, 1), ("a", 1, 4.0, 2), (None, 2, 5.0, 1), ("b", 3, 6.0, 1)], "k string, n long, v double, at int")
    merged = tables.merge(old, new, ["k", "n"], policy, "at")
    want = {
        "overwrite": [("a", 1, 4.0, "x"), ("b", 3, 6.0, None), (None, 2, 2.0, "y"), (None, 2, 5.0, None)],
        "keep": [("a", 1, 1.0, "x"), ("b", 3, 6.0, None), (None, 2, 2.0, "y"), (None, 2, 5.0, None)],
    }
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(want[policy], key=str)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Sort [") == 1 and plan.count("REPARTITION_BY_NUM") == 1
