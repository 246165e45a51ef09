"""The registered queries of the disambiguation engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import derived, feedback, identity_features, target
from ..operators.candidates import candidates, trimmed_assertions
from ..operators.order import written
from . import sql
from .fixtures import SQL as FIXTURES
from .fixtures import Tables

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of Tables, with its SQL if there is any."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE[key] = oracle
        return f

    return register


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Values to six places, as the SQL has them; -0.0 is 0.0."""
    return df.select(*keys, *[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in values])


def rounded_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in columns)


KEYS = ["person_id", "pmid"]


def _cand(t: Tables) -> DataFrame:
    return candidates(t.identity, t.article, t.link, t.curation)


def _resolved(t: Tables) -> DataFrame:
    return target.with_target(target.resolve_target_author(_cand(t)))


@query(FIXTURES + "SELECT person_id, pmid, assertion, source, journal, pub_year FROM cand", "candidates")
def _candidates(t):
    return _cand(t).select(*KEYS, "assertion", "source", "journal", "pub_year")


@query(sql.TARGET + "SELECT person_id, pmid, target_author_index FROM tgt")
def target_author(t):
    return target.resolve_target_author(_cand(t)).select(*KEYS, "target_author_index")


NAME = ["nameMatchFirstScore", "nameMatchLastScore", "nameMatchMiddleScore", "nameMatchModifierScore"]
ADDRESS = ["emailMatchScore", derived.PUBMED, derived.AFFILIATION]
COUNTS = ["articleCountScore", "authorCountScore"]


@query(sql.NAMES + f"SELECT person_id, pmid, {rounded_sql(NAME)} FROM names")
def name_scores(t):
    return rounded(identity_features.add_name_scores(_resolved(t)), KEYS, NAME)


@query(sql.EVIDENCE + f"SELECT person_id, pmid, {rounded_sql(ADDRESS)} FROM base")
def email_affil_scores(t):
    return rounded(identity_features.add_address_scores(_resolved(t)), KEYS, ADDRESS)


@query(sql.EVIDENCE + f"SELECT person_id, pmid, {rounded_sql(['organizationalUnitMatchingScore'])} FROM base")
def org_unit(t):
    return rounded(identity_features.add_address_scores(_resolved(t)), KEYS, ["organizationalUnitMatchingScore"])


@query(sql.EVIDENCE + f"SELECT person_id, pmid, {rounded_sql(['discrepancyDegreeYearScore'])} FROM base")
def degree_year(t):
    return rounded(identity_features.add_year_and_count_scores(_cand(t)), KEYS, ["discrepancyDegreeYearScore"])


@query(sql.EVIDENCE + f"SELECT person_id, pmid, {rounded_sql(COUNTS)} FROM base")
def article_author_count(t):
    return rounded(identity_features.add_year_and_count_scores(_cand(t)), KEYS, COUNTS)


@query(sql.FACTS + f"SELECT person_id, pmid, {rounded_sql(feedback.NAMES)} FROM fb")
def feedback_all(t):
    # read three times: the articles' lists are made once
    return rounded(feedback.feedback_features(written(feedback.needed(_resolved(t)))), KEYS, feedback.NAMES)


for _dim in ("Journal", "Year", "CoAuthorName", "Keyword"):
    _name = {"CoAuthorName": "feedback_coauthor"}.get(_dim, f"feedback_{_dim.lower()}")

    @query(sql.FACTS + f"SELECT person_id, pmid, {rounded_sql([f'feedbackScore{_dim}'])} FROM fb", _name)
    def _one(t, dim=_dim):
        return rounded(feedback.feedback_features(_resolved(t), dims=[dim]), KEYS, [f"feedbackScore{dim}"])


@query(
    FIXTURES
    + """, a AS (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY pub_date, pmid) AS o, row_number() OVER (PARTITION BY person_id ORDER BY pub_date DESC, pmid DESC) AS n
  FROM cand WHERE assertion = 'ACCEPTED')
SELECT person_id, pmid, assertion FROM a WHERE o > 2 AND n > 2 UNION ALL SELECT person_id, pmid, assertion FROM cand WHERE assertion = 'REJECTED'""",
    "trimmed_assertions",
)
def _trimmed(t):
    return trimmed_assertions(_cand(t))


from . import report_queries  # noqa: E402, F401  (registers its queries)
