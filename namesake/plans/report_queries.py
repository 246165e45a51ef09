"""Registered queries of retrieval, table upkeep, evaluation, reports, discovery and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.strings import jaro_winkler, keywords_of, name_key, normalize_orcid, score_key, strip_suffixes, wilson, wilson_clipped, year_in
from ..operators import derived, discover, evaluate, feedback, identity_features, model, reports, retrieve, target
from ..operators.candidates import candidates
from ..operators.order import checkpoint_folder, written
from ..operators.pairs import keyword_matches
from ..operators.trees import tree_contributions
from .. import params
from ..params import Params
from ..sources import tables
from . import sql
from .catalogue import KEYS, _cand, _resolved, query, rounded, rounded_sql
from .fixtures import SQL

SITE = Params(lenient_threshold=700, strict_threshold=200)
BEST = """, bs AS (
  SELECT * EXCLUDE (full_model) FROM (SELECT *, bool_or(model_type = 'feedbackIdentity') OVER (PARTITION BY person_id) AS full_model FROM score)
  WHERE NOT full_model OR model_type = 'feedbackIdentity')"""
EVAL = SQL + BEST + """, ev AS (
  SELECT b.person_id, b.pmid, b.model_type, b.calibrated_score * 100 AS score, (c.assertion = 'ACCEPTED')::INT AS label FROM bs b JOIN curation c USING (person_id, pmid)),
g AS (SELECT score, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS q FROM ev GROUP BY score),
cum AS (SELECT *, sum(p) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(q) OVER (ORDER BY score DESC)::BIGINT AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nn FROM g)
"""


# Retrieval

RETRIEVAL = SQL + f""", idx AS (
  SELECT a.pmid, l || ' ' || f[1] AS lenient, l || ' ' || f AS strict, a.orcid, r.entry_date, r.pub_date
  FROM (SELECT *, {sql.key('last_name')} AS l, {sql.key('first_name')} AS f FROM author) a JOIN article r USING (pmid)),
ppl AS (SELECT *, l || ' ' || f[1] AS lenient, l || ' ' || f AS strict FROM (SELECT *, {sql.key('last_name')} AS l, {sql.key('first_name')} AS f FROM identity)),
n1 AS (SELECT lenient, count(DISTINCT pmid) AS n FROM idx GROUP BY lenient), n2 AS (SELECT strict, count(DISTINCT pmid) AS n FROM idx GROUP BY strict),
dec AS (
  SELECT p.*, coalesce(n1.n, 0) AS lenient_count, CASE WHEN coalesce(n1.n, 0) > {{lenient}} THEN coalesce(n2.n, 0) END AS strict_count,
         CASE WHEN coalesce(n1.n, 0) <= {{lenient}} THEN 'lenient' WHEN coalesce(n2.n, 0) <= {{strict}} THEN 'strict' ELSE 'skipped' END AS query_type
  FROM ppl p LEFT JOIN n1 USING (lenient) LEFT JOIN n2 USING (strict)),
named AS (
  SELECT DISTINCT d.person_id, i.pmid FROM dec d JOIN idx i ON i.lenient = d.lenient WHERE query_type = 'lenient'
  UNION ALL SELECT DISTINCT d.person_id, i.pmid FROM dec d JOIN idx i ON i.strict = d.strict WHERE query_type = 'strict'),
orc AS (SELECT DISTINCT p.person_id, i.pmid FROM identity p JOIN idx i ON i.orcid = p.orcid WHERE p.orcid <> '')
"""


def index_sql(cfg):
    """The retrieval's tables at the thresholds."""
    return RETRIEVAL.replace("{lenient}", str(cfg.lenient_threshold)).replace("{strict}", str(cfg.strict_threshold))


INDEX, DEFAULT_INDEX = index_sql(SITE), index_sql(Params())


DECISIONS = "SELECT person_id, query_type, lenient_count, strict_count FROM dec"


@query(INDEX + DECISIONS)
def retrieval_decisions(t, cfg=SITE):
    return retrieve.retrieve_by_name(t.identity, retrieve.author_index(t.listed), cfg)[1]


CASCADE = "SELECT person_id, pmid FROM named"


@query(INDEX + CASCADE)
def candidates_cascade(t, cfg=SITE):
    return retrieve.retrieve_by_name(t.identity, retrieve.author_index(t.listed), cfg)[0]


UNION = "SELECT person_id, pmid, 'search' AS source FROM (SELECT * FROM named UNION SELECT * FROM orc) x WHERE NOT EXISTS (FROM link l WHERE l.person_id = x.person_id AND l.pmid = x.pmid)"


@query(INDEX + UNION)
def candidates_orcid_union(t, cfg=SITE):
    return retrieve.retrieve(t.identity, t.listed, t.link, cfg=cfg)


def _log(t):
    return t.identity.select("person_id", F.when(F.col("person_id").cast("long") % 3 > 0, F.lit("1997-06-01").cast("date")).alias("last_retrieval_date"), F.when(F.col("person_id").cast("long") % 2 == 0, F.lit("1996-06-01").cast("date")).alias("last_orcid_retrieval_date"))


WINDOW = """SELECT DISTINCT person_id, pmid, 'search' AS source FROM (
  SELECT n.person_id, n.pmid FROM named n JOIN article a USING (pmid) WHERE n.person_id::BIGINT % 3 = 0 OR a.entry_date >= DATE '1997-06-01' OR a.pub_date >= DATE '1997-06-01'
  UNION ALL SELECT o.person_id, o.pmid FROM orc o JOIN article a USING (pmid) WHERE o.person_id::BIGINT % 2 = 1 OR a.entry_date >= DATE '1996-06-01' OR a.pub_date >= DATE '1996-06-01') x
WHERE NOT EXISTS (FROM link l WHERE l.person_id = x.person_id AND l.pmid = x.pmid)"""


@query(INDEX + WINDOW)
def incremental_window(t, cfg=SITE):
    return retrieve.retrieve(t.identity, t.listed, t.link, _log(t), "update", cfg)


# SITE's thresholds reach every branch at sf0.01 but find nothing by name at sf0.1: the same at the production thresholds
for _sql, _ask in ((DECISIONS, retrieval_decisions), (CASCADE, candidates_cascade), (UNION, candidates_orcid_union), (WINDOW, incremental_window)):

    @query(DEFAULT_INDEX + _sql, f"{_ask.__name__}_default")
    def _at_defaults(t, ask=_ask):
        return ask(t, Params())


# Table upkeep


def _halves(t):
    old = t.curation.filter("pmid % 3 < 2")
    new = t.curation.filter("pmid % 3 > 0").withColumn("assertion", F.when(F.col("pmid") % 2 == 0, "REJECTED").otherwise(F.col("assertion")))
    return old, new


HALVES = SQL + """, old AS (SELECT * FROM curation WHERE pmid % 3 < 2),
new AS (SELECT person_id, pmid, CASE WHEN pmid % 2 = 0 THEN 'REJECTED' ELSE assertion END AS assertion FROM curation WHERE pmid % 3 > 0)
"""


@query(HALVES + "SELECT person_id, pmid, coalesce(o.assertion, n.assertion) AS assertion FROM old o FULL JOIN new n USING (person_id, pmid)")
def merge_keep(t):
    return tables.merge(*_halves(t), KEYS, "keep")


@query(HALVES + "SELECT person_id, pmid, coalesce(n.assertion, o.assertion) AS assertion FROM old o FULL JOIN new n USING (person_id, pmid)")
def merge_overwrite(t):
    return tables.merge(*_halves(t), KEYS, "overwrite")


@query(SQL + "SELECT i.*, coalesce(x.title, '') AS title FROM identity i LEFT JOIN (SELECT person_id, arg_max(source, pmid) AS title FROM link GROUP BY 1) x USING (person_id)")
def upsert_identities(t):
    """A roster with a row per link of the person, whose title is the link's source."""
    roster = t.link.join(t.identity.drop("title"), "person_id").withColumnsRenamed({"source": "title", "pmid": "position"})
    return tables.upsert_identities(t.identity, roster)


@query(SQL + "SELECT pmid, journal, pub_year FROM article UNION ALL SELECT pmid * 2, journal, pub_year + 1 FROM article WHERE pmid * 2 NOT IN (SELECT pmid FROM article)")
def insert_articles(t):
    stored = t.article.select("pmid", "journal", "pub_year")
    return tables.insert_articles(stored, stored.selectExpr("pmid * 2 as pmid", "journal", "pub_year + 1 as pub_year"))


def _found(t):
    """Pairs that are linked, and as many that aren't."""
    return t.curation.select(*KEYS).unionByName(t.curation.selectExpr("person_id", "-1 - pmid as pmid"))


@query(SQL + "SELECT person_id, pmid, source FROM link UNION ALL SELECT person_id, -1 - pmid, 'upload' FROM curation")
def link_uploads(t):
    return tables.link_uploads(t.link, _found(t))


@query(SQL + "SELECT person_id, pmid, CASE WHEN assertion IS NULL THEN l.source ELSE 'search' END AS source FROM link l LEFT JOIN curation c USING (person_id, pmid) UNION ALL SELECT person_id, -1 - pmid, 'search' FROM curation")
def link_found(t):
    return tables.link_found(t.link, _found(t))


@query(SQL + """SELECT person_id, pmid, model_type, calibrated_score * CASE WHEN again THEN 0.25 ELSE 1 END::DOUBLE AS calibrated_score, CASE WHEN again THEN 3 ELSE 1 END::BIGINT AS run_id,
CASE WHEN again THEN DATE '2024-03-01' ELSE DATE '2024-01-01' END AS scored_at FROM (SELECT *, model_type = 'feedbackIdentity' AS again FROM score)""")
def upsert_scores(t):
    """The scores of run 1, and those of the model with feedback of runs 2 and 3 in one batch."""
    run = lambda df, n, f: df.withColumns({"calibrated_score": F.col("calibrated_score") * f, "run_id": F.lit(n).cast("long"), "scored_at": F.lit(f"2024-0{n}-01").cast("date")})
    again = t.score.filter("model_type = 'feedbackIdentity'")
    return tables.upsert_scores(run(t.score, 1, 1.0), run(again, 2, 0.5).unionByName(run(again, 3, 0.25)))


@query(SQL + "SELECT person_id, pmid, source FROM link WHERE person_id::BIGINT % 7 <> 0")
def cascade_delete(t):
    gone = t.identity.select("person_id").unionByName(t.link.select("person_id")).filter("cast(person_id as long) % 7 = 0")
    return tables.cascade_delete({"link": t.link, "article": t.article}, gone)["link"]


@query(SQL + "SELECT s.* FROM score s WHERE person_id NOT IN (SELECT person_id FROM curation WHERE pmid % 10 = 0)")
def score_invalidation(t):
    return tables.invalidate(t.score, t.curation.filter("pmid % 10 = 0"))


@query(SQL + "SELECT l.person_id, l.pmid, l.source FROM link l WHERE pmid IN (SELECT pmid FROM article WHERE pub_year >= 1995)")
def known_links(t):
    return tables.known_only(t.link, t.article.filter("pub_year >= 1995")).select("person_id", "pmid", "source")


# Evaluation


def _eval(t):
    return evaluate.evaluation_set(t.score, t.curation)


@query(EVAL + f"SELECT person_id, pmid, model_type, label, {rounded_sql(['score'])} FROM ev")
def model_selection(t):
    return rounded(_eval(t), ["person_id", "pmid", "model_type", "label"], ["score"])


@query(EVAL + "SELECT count(*) AS n, sum(label)::BIGINT AS accepted, (count(*) - sum(label))::BIGINT AS rejected, CASE WHEN count(*) = 0 THEN 'no_data' WHEN sum(label) IN (0, count(*)) THEN 'single_class' WHEN count(*) < 50 THEN 'too_few' ELSE 'viable' END AS status FROM ev")
def viability(t):
    return evaluate.viability(_eval(t))


ROC = ["threshold", "fpr", "tpr"]


@query(EVAL + f", pt AS (SELECT score AS threshold, fp / nn AS fpr, tp / np AS tpr FROM cum UNION ALL SELECT NULL, 0, 0) SELECT {rounded_sql(ROC)} FROM pt")
def roc_points(t):
    return rounded(evaluate.roc_points(_eval(t)), [], ROC)


@query(EVAL + "SELECT round(sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END * x.p * y.q) / (max(x.np) * max(x.nn)), 6)::DOUBLE AS auc FROM cum x, cum y")
def roc_auc(t):
    return rounded(evaluate.roc_auc(_eval(t)), [], ["auc"])


@query(EVAL + f", pt AS (SELECT score AS threshold, tp / np AS recall, tp / (tp + fp) AS precision FROM cum UNION ALL SELECT NULL, 0, 1) SELECT {rounded_sql(['threshold', 'recall', 'precision'])} FROM pt")
def pr_curve(t):
    return rounded(evaluate.pr_curve(_eval(t)), [], ["threshold", "recall", "precision"])


@query(EVAL + f", pt AS (SELECT sum(p / np * (tp / (tp + fp))) AS average_precision, max(np / (np + nn)) AS baseline FROM cum) SELECT {rounded_sql(['average_precision', 'baseline'])} FROM pt")
def average_precision(t):
    return rounded(evaluate.average_precision(_eval(t)), [], ["average_precision", "baseline"])


@query(
    EVAL
    + """, b AS (SELECT least(9, floor(score / 10))::INT AS bin, score / 100 AS p, label FROM ev)
SELECT r.bin::INT AS bin, count(b.p) AS n, round(avg(b.p), 6) AS mean_score, round(avg(b.label), 6) AS fraction_positive FROM range(10) r(bin) LEFT JOIN b USING (bin) GROUP BY r.bin"""
)
def calibration_bins(t):
    return rounded(evaluate.calibration(_eval(t)), ["bin", "n"], ["mean_score", "fraction_positive"])


@query(
    EVAL
    + """, b AS (SELECT least(9, floor(score / 10))::INT AS bin, label FROM ev)
SELECT r.bin::INT AS bin, coalesce(sum(label), 0)::BIGINT AS accepted, coalesce(sum(1 - label), 0)::BIGINT AS rejected FROM range(10) r(bin) LEFT JOIN b USING (bin) GROUP BY r.bin"""
)
def score_distribution(t):
    return evaluate.distribution(_eval(t))


@query(EVAL + f", d AS (SELECT e.*, abs(score - label * 100) AS gap, first_name, last_name FROM ev e JOIN identity USING (person_id)) SELECT person_id, pmid, model_type, label, first_name, last_name, {rounded_sql(['score', 'gap'])} FROM d WHERE gap >= 50")
def disagreements(t):
    return rounded(evaluate.disagreements(_eval(t), t.identity), ["person_id", "pmid", "model_type", "label", "first_name", "last_name"], ["score", "gap"])


@query()
def bootstrap_ci(t):
    return evaluate.bootstrap_ci(_eval(t))


@query(SQL + """, run AS (SELECT person_id, DATE '1998-01-01' AS d, count(*) AS found, person_id::BIGINT % 3 = 0 AS orcid_ran FROM link WHERE person_id::BIGINT % 2 = 0 GROUP BY 1),
old AS (SELECT person_id, DATE '1996-06-01' AS d, DATE '1995-01-01' AS o FROM identity WHERE person_id::BIGINT % 5 > 0)
SELECT coalesce(r.person_id, o.person_id) AS person_id, coalesce(r.d, o.d) AS last_retrieval_date, CASE WHEN r.person_id IS NULL OR NOT orcid_ran THEN o.o ELSE r.d END AS last_orcid_retrieval_date,
  CASE WHEN r.person_id IS NULL THEN 7 ELSE found END AS articles_found, CASE WHEN r.person_id IS NULL THEN 1 ELSE 2 END::BIGINT AS run_id FROM run r FULL JOIN old o ON o.person_id = r.person_id""")
def retrieval_log(t):
    number = F.col("person_id").cast("long")
    day = lambda d: F.lit(d).cast("date")
    log = t.identity.filter(number % 5 > 0).select("person_id", day("1996-06-01").alias("last_retrieval_date"), day("1995-01-01").alias("last_orcid_retrieval_date"), F.lit(7).cast("long").alias("articles_found"), F.lit(1).cast("long").alias("run_id"))
    run = t.link.filter(number % 2 == 0).groupBy("person_id").agg(F.count("*").alias("articles_found")).withColumns({"retrieved_on": day("1998-01-01"), "run_id": F.lit(2).cast("long"), "orcid_ran": number % 3 == 0})
    return tables.update_retrieval_log(log, run)


@query(SQL + "SELECT 'identity' AS table, count(*) AS deleted FROM identity UNION ALL SELECT 'link', count(*) FROM link UNION ALL SELECT 'curation', count(*) FROM curation UNION ALL SELECT 'score', count(*) FROM score")
def wiped_rows(t):
    return tables.wipe({"identity": t.identity, "link": t.link, "curation": t.curation, "score": t.score})[1]


# Reports

WILSON = "((a / (a + r) + 3.8416 / (2 * (a + r)) - 1.96 * sqrt((a / (a + r) * (1 - a / (a + r)) + 3.8416 / (4 * (a + r))) / (a + r))) / (1 + 3.8416 / (a + r)))"
ORCIDS = sql.TARGET + BEST + f""", o AS (
  SELECT c.person_id, first_name, last_name, c.orcid AS identity_orcid, t_orcid AS id,
         count(*) FILTER (WHERE calibrated_score >= 0.5) AS a, count(*) FILTER (WHERE calibrated_score < 0.5) AS r
  FROM ct c JOIN bs USING (person_id, pmid) WHERE length(t_orcid) >= 10 GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY person_id) AS d, row_number() OVER (PARTITION BY person_id ORDER BY a DESC, r, id) AS k FROM o),
orcids AS (
  SELECT person_id, first_name, last_name, id AS orcid, round({WILSON} / sqrt(d), 4)::DOUBLE AS confidence_score,
         CASE WHEN a >= 5 AND r = 0 AND d = 1 THEN 'confirmed' WHEN a >= 2 AND r = 0 THEN 'likely' WHEN a >= 1 AND r = 0 THEN 'possible' ELSE 'unreliable' END AS confidence_tier,
         a AS accepted_articles, r AS rejected_articles, a + r AS total_articles, identity_orcid, identity_orcid <> '' AND id = identity_orcid AS orcid_matches_identity
  FROM r WHERE k = 1)
"""


def _orcids(t):
    return reports.infer_orcids(t.score, _resolved(t), threshold=0.5)


@query(ORCIDS + "SELECT * FROM orcids")
def orcid_inference(t):
    return _orcids(t)


@query(ORCIDS + "SELECT confidence_tier, count(*) AS persons FROM orcids GROUP BY 1")
def orcid_tiers(t):
    return reports.orcid_tiers(_orcids(t))


@query(ORCIDS + "SELECT *, 'https://orcid.org/' || orcid AS orcid_link FROM orcids")
def orcid_export(t):
    return reports.orcid_export(_orcids(t))


@query(
    SQL
    + """SELECT (SELECT count(*) FROM identity) AS persons, (SELECT count(*) FROM article) AS articles,
  (SELECT count(*) FILTER (WHERE source = 'upload') FROM link) AS uploaded, (SELECT count(*) FILTER (WHERE source = 'search') FROM link) AS searched,
  count(*) AS scores, count(DISTINCT person_id) AS scored_persons, count(*) FILTER (WHERE calibrated_score >= 0.95) AS high, count(*) FILTER (WHERE calibrated_score < 0.3) AS unlikely,
  count(*) FILTER (WHERE calibrated_score >= 0.3 AND calibrated_score < 0.95) AS review,
  (SELECT count(*) FROM (SELECT DISTINCT s.person_id, s.pmid FROM score s JOIN curation c USING (person_id, pmid))) AS assertions FROM score"""
)
def pipeline_status(t):
    return reports.pipeline_status(t.identity, t.article, t.link, t.score, t.curation)


@query(
    SQL
    + """SELECT i.person_id, first_name, last_name, coalesce(articles, 0) AS articles, coalesce(scored, 0) AS scored FROM identity i
  LEFT JOIN (SELECT person_id, count(*) AS articles FROM link GROUP BY 1) a USING (person_id) LEFT JOIN (SELECT person_id, count(DISTINCT pmid) AS scored FROM score GROUP BY 1) s USING (person_id)"""
)
def roster_counts(t):
    return reports.roster_counts(t.identity, t.link, t.score)


@query(
    SQL
    + """SELECT person_id, count(*) AS total, count(*) FILTER (WHERE assertion = 'ACCEPTED') AS accepted, count(*) FILTER (WHERE assertion = 'REJECTED') AS rejected,
  count(*) FILTER (WHERE assertion IS NULL) AS pending, count(*) FILTER (WHERE assertion = 'ACCEPTED') / greatest(count(assertion), 1) AS rate FROM link LEFT JOIN curation USING (person_id, pmid) GROUP BY person_id"""
)
def person_stats(t):
    return reports.person_stats(t.link, t.curation)


@query(SQL + "SELECT person_id, count(*) AS total, count(*) FILTER (WHERE source = 'upload') AS uploaded, count(*) FILTER (WHERE source = 'search') AS retrieved, any_value(first_name) AS first_name, any_value(last_name) AS last_name FROM link LEFT JOIN identity USING (person_id) GROUP BY person_id")
def article_summary(t):
    return reports.article_summary(t.link, t.identity)


@query(SQL + "SELECT person_id, pmid, model_type, calibrated_score, journal, pub_year, coalesce(assertion, '') AS assertion FROM score JOIN article USING (pmid) LEFT JOIN curation USING (person_id, pmid)")
def scored_articles(t):
    return reports.sort_choice(reports.scored_articles(t.score, t.article, t.curation), "year", pending_first=True)


@query(
    SQL
    + BEST
    + """SELECT person_id, least(9, floor(calibrated_score * 10))::INT AS bin, count(*) FILTER (WHERE assertion = 'ACCEPTED') AS accepted,
  count(*) FILTER (WHERE assertion = 'REJECTED') AS rejected, count(*) FILTER (WHERE assertion IS NULL) AS uncurated FROM bs LEFT JOIN curation USING (person_id, pmid) GROUP BY ALL"""
)
def score_histogram(t):
    return reports.score_histogram(t.score, t.curation)


@query(SQL + "SELECT model_type, CASE WHEN calibrated_score >= 0.95 THEN 'high' WHEN calibrated_score >= 0.3 THEN 'review' ELSE 'unlikely' END AS band, count(*) AS n FROM score GROUP BY ALL")
def score_bands(t):
    return reports.score_bands(t.score)


@query(SQL + f", s AS (SELECT avg(calibrated_score) AS mean_score, median(calibrated_score) AS median_score, count(*) FILTER (WHERE calibrated_score > 0.5) AS over_half, count(*) FILTER (WHERE calibrated_score < 0.3) AS under_third FROM score) SELECT over_half, under_third, {rounded_sql(['mean_score', 'median_score'])} FROM s")
def score_summary(t):
    return rounded(reports.score_summary(t.score), ["over_half", "under_third"], ["mean_score", "median_score"])


@query(SQL + ", e AS (SELECT min(calibrated_score) AS lo, max(calibrated_score) AS hi FROM score) SELECT least(9, floor((calibrated_score - lo) / ((hi - lo) / 10)))::INT AS bin, count(*) AS n FROM score, e GROUP BY 1")
def equal_width_histogram(t):
    return reports.equal_width_histogram(t.score)


@query(
    SQL
    + """, f AS (SELECT count(*) AS persons, sum((middle_name <> '')::INT + (primary_email <> '')::INT + (primary_institution <> '')::INT + (department <> '')::INT + (orcid <> '')::INT + (doctoral_year > 0)::INT)::BIGINT AS filled FROM identity)
SELECT persons, filled, round(filled * 100 / (persons * 6), 6)::DOUBLE AS percent FROM f"""
)
def completeness(t):
    return rounded(reports.completeness(t.identity), ["persons", "filled"], ["percent"])


@query(SQL + "SELECT count(DISTINCT person_id) AS persons, count(*) AS total, count(*) FILTER (WHERE assertion = 'ACCEPTED') AS accepted, count(*) FILTER (WHERE assertion = 'REJECTED') AS rejected FROM curation")
def training_overview(t):
    return reports.training_overview(t.curation)


@query(SQL + BEST + "SELECT person_id, pmid, CASE WHEN calibrated_score >= 0.9 THEN 'ACCEPTED' ELSE 'REJECTED' END AS assertion FROM bs b WHERE (calibrated_score >= 0.9 OR calibrated_score < 1 - 0.9::DOUBLE) AND NOT EXISTS (FROM curation c WHERE c.person_id = b.person_id AND c.pmid = b.pmid)")
def bulk_curation(t):
    return reports.bulk_curation(t.score, t.curation)


RUN = SQL + BEST + """, run AS (
  SELECT person_id, article_count, coalesce(scored_count, 0) AS scored_count, min_score, max_score, coalesce(scored_count, 0) > 0 AS succeeded
  FROM (SELECT person_id, count(*) AS article_count FROM link GROUP BY 1) LEFT JOIN (SELECT person_id, count(*) AS scored_count, min(calibrated_score) AS min_score, max(calibrated_score) AS max_score FROM bs GROUP BY 1) USING (person_id))
"""


@query(RUN + "SELECT * FROM run")
def run_summary(t):
    return reports.run_summary(t.link, t.score)


@query(RUN + "SELECT count(*) FILTER (WHERE succeeded) AS succeeded, count(*) FILTER (WHERE NOT succeeded) AS failed, count(*) AS total FROM run")
def run_totals(t):
    return reports.run_totals(reports.run_summary(t.link, t.score))


@query(SQL + "SELECT person_id, count(*) FILTER (WHERE assertion = 'ACCEPTED') AS accepted, count(*) FILTER (WHERE assertion = 'REJECTED') AS rejected FROM curation GROUP BY 1")
def curation_counts(t):
    return reports.curation_counts(t.curation)


@query(SQL + "SELECT person_id, pmid, journal AS title, journal, pub_year, CASE WHEN assertion = '' THEN 'PENDING' ELSE assertion END AS status FROM (SELECT * REPLACE (journal[:5] AS journal) FROM cand)")
def article_listing(t):
    return reports.article_listing(_cand(t).withColumn("title", F.col("journal")), 5, 5, None)


@query(SQL + "SELECT person_id, pmid, 'PENDING' AS status FROM cand WHERE assertion = ''")
def pending(t):
    return reports.with_status(_cand(t), "PENDING").select(*KEYS, "status")


@query(SQL + "SELECT (SELECT count(*) FROM identity) AS researchers, (SELECT count(*) FROM article) AS articles, (SELECT count(*) FROM curation) AS curated")
def dashboard_totals(t):
    return reports.dashboard_totals(t.identity, t.article, t.curation)


@query(SQL + "SELECT person_id, list(DISTINCT pmid ORDER BY pmid) AS pmids FROM link GROUP BY 1")
def pmid_lists(t):
    return reports.pmid_lists(t.link)


@query(SQL + "SELECT * FROM identity JOIN (SELECT '' AS title) ON true")
def identities(t):
    return reports.identities(t.identity)


@query(SQL + "SELECT 1 AS run_id, min(pub_date) AS started_at, max(pub_date) AS completed_at, count(DISTINCT person_id) AS total FROM score JOIN article USING (pmid)")
def run_backfill(t):
    rows = t.score.join(t.article.select("pmid", F.col("pub_date").alias("scored_at")), "pmid").withColumn("run_id", F.lit(None).cast("int"))
    return reports.run_backfill(rows)[0]


@query(
    SQL
    + """, x AS (SELECT person_id, first_name, last_name, pmid, CASE WHEN regexp_matches(journal, '^[=+\\-@]') THEN '''' || journal ELSE journal END AS journal, pub_year, model_type, round_even(calibrated_score::DECIMAL(38, 12) * 100, 1)::DOUBLE AS score,
  'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' AS link FROM score JOIN article USING (pmid) JOIN identity USING (person_id)) SELECT * FROM x WHERE score >= 50"""
)
def score_export(t):
    return reports.score_export(t.score, t.article, t.identity, threshold=50)


@query(
    sql.TARGET
    + BEST
    + """SELECT c.person_id, c.pmid, journal, pub_year, trim(coalesce(t_first, '') || ' ' || coalesce(t_last, '')) AS target_author, target_author_index + 1 AS target_rank, coalesce(n_authors, 0)::INT AS author_count, model_type, calibrated_score,
  CASE WHEN assertion = '' THEN 'PENDING' ELSE assertion END AS status FROM ct c LEFT JOIN bs USING (person_id, pmid)"""
)
def full_export(t):
    return reports.full_export(_resolved(t), t.score)


@query(SQL + "SELECT person_id, pmid, assertion FROM curation")
def curation_export(t):
    return reports.curation_export(t.curation)


# Discovery

DOCS = r"SELECT regexp_replace(lower(d), '\.+$', '') AS domain, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@([\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+)', 1)) AS d FROM documents) GROUP BY 1"


@query(DOCS)
def email_domains(t):
    return discover.email_domains(t.read("documents"), "text", None)


ADDRESSES = SQL + """, aff AS (SELECT replace(affiliation, 'STANDARD', 'University of the') AS affiliation FROM author)
, seg AS (SELECT trim(unnest(string_split(affiliation, ','))) AS name FROM aff),
inst AS (SELECT name, count(*) AS n FROM seg WHERE NOT regexp_matches(name, '^\\d{5}|USA$|^[A-Z]{2}$|^\\d|United States|Canada|UK|China|Japan|Germany|France') AND NOT contains(name, '@')
  AND regexp_matches(lower(name), 'university|hospital|center|centre|institute|college|school|department|division|faculty|program|programme|laboratory|lab') AND length(name) > 5 GROUP BY 1)
, kw AS (SELECT *, string_split(lower(name), ' ') AS w FROM inst)
, kx AS (SELECT *, [x FOR x IN w IF x NOT IN ('of', 'the', 'for', 'and', 'to', 'in', 'at', 'on', 'a', 'an', '')] AS plain FROM kw)
, ky AS (SELECT *, [x FOR x IN plain IF x NOT IN ('university', 'hospital', 'center', 'centre', 'institute', 'college', 'school', 'department', 'division', 'faculty', 'program', 'programme', 'laboratory', 'lab')] AS telling FROM kx)
SELECT name, n, array_to_string((CASE WHEN len(telling) > 0 THEN telling ELSE plain END)[:4], '|') AS keywords FROM ky"""


@query(ADDRESSES)
def institution_names(t):
    rows = t.author.select(F.regexp_replace("affiliation", "STANDARD", "University of the").alias("affiliation"))
    return discover.institution_names(rows, k=None)


@query(SQL + "SELECT affiliation, count(*) AS n FROM author WHERE pmid IN (SELECT a.pmid FROM author a JOIN article r USING (pmid) WHERE contains(affiliation, '@mail.example.com') AND pub_year BETWEEN 1994 AND 1996) GROUP BY 1")
def domain_affiliations(t):
    return discover.affiliations(t.article, "mail.example.com", (1994, 1996)).groupBy("affiliation").agg(F.count("*").alias("n"))


STOP = ", ".join(f"'{w}'" for w in params.STOPWORDS)
GENERIC = ", ".join(f"'{w}'" for w in params.GENERIC_WORDS)
PLAIN = f"[x FOR x IN string_split(lower(primary_institution), ' ') IF x NOT IN ({STOP}, '')]"
TELLING = f"[x FOR x IN {PLAIN} IF x NOT IN ({GENERIC})]"
KEYWORDS = f"array_to_string((CASE WHEN len({TELLING}) > 0 THEN {TELLING} ELSE {PLAIN} END)[:4], '|')"


@query(SQL + f"SELECT person_id, {sql.key('first_name')} AS key_a, {sql.skey('first_name')} AS key_b, {KEYWORDS} AS keywords FROM identity")
def name_keys(t):
    return t.identity.select("person_id", name_key(F.col("first_name")).alias("key_a"), score_key(F.col("first_name")).alias("key_b"), keywords_of(F.col("primary_institution")).alias("keywords"))


CLIPPED_WILSON = "greatest(0, least(1, (a / (a + r) + z * z / (2 * (a + r)) - z * sqrt((a / (a + r) * (1 - a / (a + r)) + z * z / (4 * (a + r))) / (a + r))) / (1 + z * z / (a + r))))"


@query(SQL + f""", s AS (
  SELECT person_id, count(*) FILTER (WHERE assertion = 'ACCEPTED')::DOUBLE AS a, count(*) FILTER (WHERE assertion = 'REJECTED')::DOUBLE AS r
  FROM identity LEFT JOIN curation USING (person_id) GROUP BY 1), z AS (SELECT 1.959963984540054::DOUBLE AS z)
SELECT person_id, round(CASE WHEN a + r > 0 THEN {WILSON} ELSE 0 END, 6) + 0.0 AS wilson, round(CASE WHEN a + r > 0 THEN {CLIPPED_WILSON} ELSE 0.5 END, 6) + 0.0 AS wilson_clipped FROM s, z""")
def wilson_bounds(t):
    a, r = F.coalesce("accepted", F.lit(0)), F.coalesce("rejected", F.lit(0))
    counts = t.identity.select("person_id").join(reports.curation_counts(t.curation), "person_id", "left")
    return rounded(counts.select("person_id", wilson(a, r).alias("wilson"), wilson_clipped(a, r).alias("wilson_clipped")), ["person_id"], ["wilson", "wilson_clipped"])


# Derived features, models

DERIVED = [c for c in derived.IDENTITY_ONLY if c != "nameJaroWinkler"]
POS = [f"({c})" for c in ("nameMatchFirstScore", "emailMatchScore", "0.0", "0.0", "organizationalUnitMatchingScore", "affil", "affil", "0.0", "0.0", "0.0")]
NEG = ["nameMatchFirstScore", "nameMatchMiddleScore", "nameMatchModifierScore", "affil", "discrepancyDegreeYearScore", "articleCountScore"]
SHARED_SQL = f"""
  ({' + '.join(f'({c} > 0)::INT' for c in POS)}) - ({' + '.join(f'({c} < 0)::INT' for c in NEG)}) AS netEvidenceCount,
  articleCountScore * (1 - identityStrength) AS ambiguityRisk, nameMatchFirstScore * affil AS nameInstitutionInteraction,
  least(nameMatchFirstScore, nameMatchMiddleScore, affil, discrepancyDegreeYearScore, 0.0) AS worstSingleEvidence,
  least(nameMatchFirstScore, nameMatchLastScore, nameMatchMiddleScore) AS nameQualityMin, 0.0 AS firstNameFrequencyScore, 0.0 AS nameGenderConflict,
  length(first_name) AS firstNameLength, 0.0 AS nameFrequencyMatchInteraction, nameMatchFirstScore * ln(1 + length(first_name)) AS nameLengthMatchInteraction,
  nameMatchFirstScore * nameMatchMiddleScore AS firstMiddleMatchInteraction, sign(nameMatchFirstScore) * sign(nameMatchMiddleScore) AS nameMatchMiddleAgreement,
  1 - levenshtein(lower(first_name), lower(coalesce(t_first, ''))) / greatest(length(first_name), length(coalesce(t_first, '')), 1) AS nameEditDistanceNorm,
  length(coalesce(t_first, '')) / greatest(length(first_name), 1) AS forenameLengthRatio,
  (length(first_name) + length(middle_name)) / greatest(length(coalesce(t_first, '')), 1) AS firstMiddleCoverage,
  CASE kind WHEN 'exact' THEN 5 WHEN 'initial' THEN 4 WHEN 'fuzzy' THEN 3 WHEN 'same_initial' THEN 1 WHEN 'conflict' THEN 0 ELSE 2 END AS nameMatchTypeOrdinal,
  (emailMatchScore <> 0)::INT AS hasEmail, (discrepancyDegreeYearScore <> 0)::INT AS hasDegreeYear, 0 AS hasGrants, 0 AS hasRelationships, 0 AS hasGender,
  (organizationalUnitMatchingScore <> 0)::INT AS hasOrgUnit, nameMatchFirstScore * identityStrength AS nameAffilStrength,
  list_stddev_samp([{', '.join(POS)}]::DOUBLE[]) AS evidenceConsistency,
  nameMatchFirstScore * nameMatchLastScore * nameMatchMiddleScore AS nameMatchConsistency, 0.0 AS affilRelationshipInteraction, 0.0 AS scopusPubmedAffilAgreement"""
STRENGTH = "greatest(least(1, greatest(0, emailMatchScore) / 0.9), least(1, greatest(0, affil) / 0.95){})::DOUBLE AS identityStrength"


def _kept_features(t, **lookups):
    """Base features, made once and kept without the articles' lists: the features of names read them several times."""
    return written(identity_features.identity_features(_resolved(t), **lookups).drop("authors", "keywords"))


@query(sql.EVIDENCE + f", st AS (SELECT *, {STRENGTH.format('')} FROM base), dv AS (SELECT *, {SHARED_SQL} FROM st) SELECT person_id, pmid, {rounded_sql(DERIVED)} FROM dv")
def derived_identity(t):
    return rounded(derived.derived_identity(_kept_features(t)), KEYS, DERIVED)


FB = [c for c in (*derived.FEEDBACK_ONLY, *derived.SHARED) if c != "nameJaroWinkler"]
CLIPPED = {"feedbackScoreCoAuthorName", "feedbackScoreYear", "feedbackScoreOrcidCoAuthor"}
FILLED = " + ".join(f"({c} <> 0)::INT" for c in feedback.NAMES)
FB_SQL = f"""
  (1 - low) * (1 - identityStrength) * (1 - exp(-(ta + tr) / 10)) AS uncertainRejectionRisk, low AS acceptanceRateLowerBound, ln(1 + ta + tr) AS feedbackConfidence,
  filled / 15 AS feedbackDensity, filled / 15 * identityStrength AS feedbackIdentityInteraction, CASE WHEN ta > 0 THEN 15 - filled ELSE 0 END AS informedAbsenceCount,
  CASE WHEN ta > 0 THEN 15 - filled ELSE 0 END * ln(1 + ta) AS informedAbsenceIntensity,
  CASE WHEN nameMatchFirstScore < -2 AND feedbackScoreTargetAuthorName < 0 THEN abs(nameMatchFirstScore) * abs(feedbackScoreTargetAuthorName) ELSE 0 END AS nameConflictConfirmed,
  0 AS hasTextEvidence, 0 AS textSimNoCoauthorInteraction, 0 AS textSimNewJournalInteraction, 0 AS textSimFeedbackConfInteraction, 0 AS textSimAffilGapInteraction,
  0 AS bibCouplingFeedbackConfInteraction, 0 AS bibCouplingHighConfOnly, 0 AS hasBibCouplingSignal, worstSingleEvidence AS worstSingleEvidenceExtended, netEvidenceCount AS netEvidenceCountExtended"""
FEEDBACK_TABLES = sql.FACTS + sql.EVIDENCE[len(sql.TARGET) :]


@query(
    FEEDBACK_TABLES
    + f""", bf AS (SELECT b.*, f.* EXCLUDE (person_id, pmid) REPLACE ({', '.join(f'greatest(0, f.{c}) AS {c}' for c in sorted(CLIPPED))}) FROM base b JOIN fb f ON f.person_id = b.person_id AND f.pmid = b.pmid),
st AS (SELECT *, {STRENGTH.format(', least(1, greatest(0, feedbackScoreOrcid) / 0.9)')}, {FILLED} AS filled, 1.959963984540054::DOUBLE AS z, (ta + tr)::DOUBLE AS nn, CASE WHEN ta + tr > 0 THEN ta / (ta + tr) END AS pp FROM bf),
lo AS (SELECT *, CASE WHEN nn > 0 THEN greatest(0, least(1, (pp + z * z / (2 * nn) - z * sqrt((pp * (1 - pp) + z * z / (4 * nn)) / nn)) / (1 + z * z / nn))) ELSE 0.5 END AS low FROM st),
dv AS (SELECT *, {SHARED_SQL} FROM lo), dw AS (SELECT *, {FB_SQL} FROM dv) SELECT person_id, pmid, {rounded_sql(FB)} FROM dw"""
)
def derived_feedback(t):
    # candidates and their targets are used many times over: they are made once
    return rounded(model.features(written(_resolved(t)), t.curation), KEYS, FB)


LOOKUPS = ["firstNameFrequencyScore", "genderScoreIdentityArticleDiscrepancy", "nameGenderConflict", "nameFrequencyMatchInteraction", "hasGender", "worstSingleEvidence"]
GENDER = f"CASE WHEN g1.name IS NULL OR g2.name IS NULL THEN 0 ELSE {params.GENDER_LEAST} + {params.GENDER_RANGE} * CASE WHEN g1.gender = g2.gender THEN least(g1.probability, g2.probability) ELSE 1 - least(g1.probability, g2.probability) END END"
LOOKUP_SQL = f""", word AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part),
freq AS (SELECT split_part(p_name, ' ', 1) AS name, count(*) / 100.0::DOUBLE AS score FROM part GROUP BY 1),
med AS (SELECT list_sort(list(score))[count(*) // 2 + 1] AS median FROM freq),
gen AS (SELECT w AS name, CASE WHEN length(w) % 2 = 0 THEN 'f' ELSE 'm' END AS gender, 0.5 + length(w) % 5 / 10.0::DOUBLE AS probability FROM word
        UNION ALL SELECT w || 'a', 'f', 0.9::DOUBLE FROM word),
lk AS (SELECT b.*, coalesce(f.score, median) AS firstNameFrequencyScore, ({GENDER})::DOUBLE AS genderScoreIdentityArticleDiscrepancy
       FROM base b CROSS JOIN med LEFT JOIN freq f ON f.name = lower(first_name) LEFT JOIN gen g1 ON g1.name = lower(first_name) LEFT JOIN gen g2 ON g2.name = lower(coalesce(t_first, ''))),
lv AS (SELECT *, CASE WHEN nameMatchFirstScore < -2 AND genderScoreIdentityArticleDiscrepancy < 0 THEN abs(nameMatchFirstScore) * abs(genderScoreIdentityArticleDiscrepancy) ELSE 0 END AS nameGenderConflict,
  nameMatchFirstScore * firstNameFrequencyScore AS nameFrequencyMatchInteraction, (genderScoreIdentityArticleDiscrepancy <> 0)::INT AS hasGender,
  least(nameMatchFirstScore, nameMatchMiddleScore, affil, discrepancyDegreeYearScore, genderScoreIdentityArticleDiscrepancy) AS worstSingleEvidence FROM lk)"""


@query(sql.EVIDENCE + LOOKUP_SQL + f" SELECT person_id, pmid, {rounded_sql(LOOKUPS)} FROM lv")
def derived_lookups(t):
    """Name frequencies and genders, from tables of the given names that the parts have."""
    first = F.split("p_name", " ")[0]
    parts = t.read("part").select(first.alias("name"))
    frequencies = parts.groupBy("name").agg((F.count("*") / 100.0).alias("score"))
    names, n = parts.distinct(), F.length("name")
    genders = names.select("name", F.when(n % 2 == 0, "f").otherwise("m").alias("gender"), (0.5 + n % 5 / 10.0).alias("probability"))
    genders = genders.unionByName(names.select(F.concat("name", F.lit("a")).alias("name"), F.lit("f").alias("gender"), F.lit(0.9).alias("probability")))
    return rounded(derived.derived_identity(_kept_features(t, genders=genders), frequencies), KEYS, LOOKUPS)


SUBFIELD = ["journalSubfieldScore", "feedbackScoreJournalSubField", "feedbackScoreCites"]
_ISSN = "'1111' || lpad((pmid % {})::VARCHAR, 4, '0')"
SUBFIELD_SQL = SQL + f""", sub AS (SELECT '1111' || lpad((p_partkey % 40)::VARCHAR, 4, '0') AS issn, min(p_brand) AS subfield FROM part GROUP BY 1),
dep AS (SELECT DISTINCT c_mktsegment AS department, subfield FROM customer, sub WHERE length(c_mktsegment) % 2 = right(subfield, 1)::INT % 2),
js AS (SELECT pmid, coalesce(s1.subfield, s2.subfield, '') AS sf FROM article LEFT JOIN sub s1 ON s1.issn = {_ISSN.format(50)} LEFT JOIN sub s2 ON s2.issn = {_ISSN.format(7)}),
facts AS (
  SELECT person_id, pmid, assertion, 'JournalSubField' AS dim, lower(sf) AS value FROM cand JOIN js USING (pmid)
  UNION ALL SELECT person_id, pmid, assertion, 'Cites', '10.1/' || pmid % 9 FROM cand)
""" + sql.FACTS[sql.FACTS.index(",\nf AS (") :].replace("('Year', 0.0)", "('Year', 0.0), ('JournalSubField', 0.7), ('Cites', 0.5)") + f""", sc AS (
  SELECT c.person_id, c.pmid, CASE WHEN c.department = '' OR sf = '' THEN 0 WHEN EXISTS (FROM dep d WHERE d.department = c.department AND d.subfield = sf) THEN 0.47 ELSE -0.47 END AS journalSubfieldScore
  FROM cand c JOIN js USING (pmid)) SELECT person_id, pmid, {rounded_sql(SUBFIELD)} FROM sc JOIN fb USING (person_id, pmid)"""


@query(SUBFIELD_SQL)
def derived_subfields(t):
    """Subfields of journals and departments from tables made of the parts' makers, DOIs that articles share."""
    part = t.read("part")
    of = lambda n: F.concat(F.lit("1111-"), F.lpad((F.col("pmid") % n).cast("string"), 4, "0"))
    article = t.article.withColumns({"journal_issn": F.array(of(50), of(7)), "doi": F.concat(F.lit("10.1/"), (F.col("pmid") % 9).cast("string"))})
    issn = F.concat(F.lit("1111"), F.lpad((F.col("p_partkey") % 40).cast("string"), 4, "0"))
    subfields = part.groupBy(issn.alias("issn")).agg(F.min("p_brand").alias("subfield"))
    sides = subfields.select("subfield").distinct().withColumn("odd", F.substring("subfield", -1, 1).cast("int") % 2)
    departments = t.read("customer").select(F.col("c_mktsegment").alias("department")).distinct().withColumn("odd", F.length("department") % 2).join(sides, "odd")
    cand = target.with_target(target.resolve_target_author(candidates(t.identity, article, t.link, t.curation)))
    rows = identity_features.add_lookup_scores(cand, departments, None, subfields)
    scores = feedback.feedback_features(rows, dims=["JournalSubField", "Cites"])
    return rounded(rows.select(*KEYS, "journalSubfieldScore").join(scores, KEYS), KEYS, SUBFIELD)


def _suffixes_sql(c):
    """A column without suffixes, one after the other."""
    out = f"SELECT p_partkey, {c} AS surname, made FROM x"
    for s in params.SUFFIXES:
        for tail in (f", {s}".lower(), f" {s}".lower()):
            out = f"SELECT p_partkey, made, CASE WHEN ends_with(lower(surname), '{tail}') THEN trim(surname[:length(surname) - {len(tail)}]) ELSE surname END AS surname FROM ({out})"
    return out


MADE = """WITH x AS (SELECT p_partkey, split_part(p_name, ' ', 2) || CASE p_partkey % 6 WHEN 0 THEN ', Jr' WHEN 1 THEN ' MD' WHEN 2 THEN ' III' WHEN 3 THEN ' PhD, Sr' ELSE '' END AS surname,
  CASE p_partkey % 4 WHEN 0 THEN (1980 + p_size)::VARCHAR || ' Jan-Feb' WHEN 1 THEN 'Spring ' || p_size WHEN 2 THEN (1950 + p_size)::VARCHAR ELSE '' END AS made,
  CASE p_partkey % 4 WHEN 0 THEN 'https://orcid.org/0000-' || p_partkey WHEN 1 THEN 'http://www.orcid.org/0000-' || p_partkey || '/' WHEN 2 THEN ' 0000-' || p_partkey || ' ' ELSE '' END AS orcid, p_name FROM part)"""


@query(
    MADE
    + rf""", s AS ({_suffixes_sql('surname')})
SELECT p_partkey, s.surname, CASE WHEN regexp_matches(split_part(trim(s.made), ' ', 1), '^[0-9]+$') THEN split_part(trim(s.made), ' ', 1)::INT ELSE 0 END AS year,
  regexp_replace(trim(orcid), 'https?://(www\.)?orcid\.org/|[ /]', '', 'g') AS orcid,
  (contains(lower(p_name), 'a') AND contains(lower(p_name), 'ee')) OR contains(lower(p_name), 'blu') AS matched FROM s JOIN x USING (p_partkey)"""
)
def text_values(t):
    """Name suffixes, free dates, ORCID addresses and keyword groups, in values made of the parts'."""
    k, n = F.col("p_partkey"), F.col("p_size")
    pick = lambda by, *options: F.coalesce(*[F.when(k % by == i, o) for i, o in enumerate(options)], F.lit(""))
    surname = F.concat(F.split("p_name", " ")[1], pick(6, F.lit(", Jr"), F.lit(" MD"), F.lit(" III"), F.lit(" PhD, Sr")))
    made = pick(4, F.concat((1980 + n).cast("string"), F.lit(" Jan-Feb")), F.concat(F.lit("Spring "), n.cast("string")), (1950 + n).cast("string"))
    number = k.cast("string")
    orcid = pick(4, F.concat(F.lit("https://orcid.org/0000-"), number), F.concat(F.lit("http://www.orcid.org/0000-"), number, F.lit("/")), F.concat(F.lit(" 0000-"), number, F.lit(" ")))
    groups = t.spark.createDataFrame([("1", "a"), ("1", "ee"), ("2", "blu")], "group string, word string")
    rows = keyword_matches(t.read("part"), "p_name", groups, "matched")
    return rows.select("p_partkey", strip_suffixes(surname).alias("surname"), year_in(made).alias("year"), normalize_orcid(orcid).alias("orcid"), "matched")


# What is done with scores that are there: the table's own stand for a model's

@query(SQL + "SELECT count(*) FILTER (WHERE assertion = 'ACCEPTED') AS accepted, count(*) AS decided, count(*) FILTER (WHERE assertion = 'ACCEPTED') >= 10 AS can_train, count(*) >= 100 AS advised FROM curation")
def training_gates(t):
    return model.gates(t.curation)


BOTH = SQL + ", a AS (SELECT * FROM score WHERE model_type = 'feedbackIdentity'), b AS (SELECT * FROM score WHERE model_type = 'identityOnly') "


@query(BOTH + "SELECT person_id, pmid, a.calibrated_score AS score_a, b.calibrated_score AS score_b FROM a JOIN b USING (person_id, pmid)")
def model_comparison(t):
    return model.compare(t.score.filter("model_type = 'feedbackIdentity'"), t.score.filter("model_type = 'identityOnly'"))


@query(BOTH + "SELECT person_id, pmid, round(greatest(0, least(1, a.calibrated_score, 33 * (b.calibrated_score / (25 + pmid % 10)))), 6) + 0.0 AS calibrated_score, a.calibrated_score > 33 * (b.calibrated_score / (25 + pmid % 10)) AS capped FROM a JOIN b USING (person_id, pmid)")
def score_safety_net(t):
    """The cap of scores with feedback by small shares of those without, which some are over."""
    pairs = model.compare(t.score.filter("model_type = 'feedbackIdentity'"), t.score.filter("model_type = 'identityOnly'"))
    rows = model.safety_net(pairs.select(*KEYS, F.col("score_a").alias("calibrated_score"), (F.col("score_b") / (25 + F.col("pmid") % 10)).alias("identity_score")))
    return rows.select(*KEYS, (F.round("calibrated_score", 6) + F.lit(0.0)).alias("calibrated_score"), "capped")


@query(EVAL + """, m AS (SELECT avg(((score >= 50) = (label = 1))::INT) AS accuracy, count(*) FILTER (WHERE score >= 50 AND label = 1) / greatest(count(*) FILTER (WHERE score >= 50), 1) AS precision,
  count(*) FILTER (WHERE score >= 50 AND label = 1) / greatest(sum(label), 1) AS recall FROM ev),
au AS (SELECT sum(p * (nn - fp + q / 2)) / (max(np) * max(nn)) AS auc FROM (SELECT *, q * 1.0 AS qq FROM cum))
SELECT """ + rounded_sql(["accuracy", "precision", "recall", "auc"]) + " FROM m, au")
def score_metrics(t):
    rows = _eval(t).select((F.col("score") / 100).alias("calibrated_score"), F.col("label"))
    return rounded(model.validate(rows), [], ["accuracy", "precision", "recall", "auc"])


@query(SQL + "SELECT DISTINCT person_id, model_type FROM score s WHERE NOT EXISTS (SELECT 1 FROM score c WHERE c.person_id = s.person_id AND c.model_type = s.model_type AND c.pmid % 7 = 0)")
def score_cache_misses(t):
    """Persons and models without a kept score, where those of every seventh article are kept."""
    wanted = t.score.select("person_id", "model_type").distinct()
    cache = t.score.filter("pmid % 7 = 0").select("person_id", "model_type", F.lit("m1").alias("model_dir")).distinct()
    return model.uncached(wanted, cache, "m1")


@query(name="jaro_winkler")
def name_similarity(t):
    pairs = _resolved(t).select(F.lower("first_name").alias("a"), F.lower(F.coalesce("target.first_name", F.lit(""))).alias("b")).distinct()
    return pairs.withColumn("similarity", jaro_winkler(F.col("a"), F.col("b")))


def _models(t, *others):
    """The model with feedback of the table's own decisions, its held-out rows, and all rows with what it and the others read:
    computed once and kept, without the articles' lists."""
    features = model.features(written(_resolved(t)), t.curation)
    rows = written(features.select(*KEYS, "label", *dict.fromkeys([*model.FEEDBACK, *others])))
    full, held = model.train(rows, model.FEEDBACK)
    return rows, full, held


@query()
def model_scores(t):
    rows, full, _ = _models(t, "identityOnlyStrength", *model.IDENTITY)
    plain, _ = model.train(model.identity_view(rows), model.IDENTITY)
    return model.score(rows, full, plain)


@query()
def model_validation(t):
    return model.validate(_models(t)[2])


@query()
def contributions(t):
    rows, full, _ = _models(t)
    model_dir = f"{checkpoint_folder(t.spark)}/model-{full.key}"
    full.save(model_dir)
    return model.top_contributions(tree_contributions(rows, full, model_dir))
