"""Reports over persons, articles, links, decisions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import guard_cell, normalize_orcid, wilson
from .order import quantile, written

ARTICLE_LINK = "https://pubmed.ncbi.nlm.nih.gov/"


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def percent(c: Column, places: int) -> Column:
    """A share in per cent, rounded half-even as the decimal that it stands for: as a double, 0.0145 * 100 is over 1.45."""
    exact = F.bround(c.try_cast("decimal(20,12)") * F.lit(100).cast("decimal(3,0)"), places).cast("double")
    return F.coalesce(exact, half_even(c * 100, places))


def best_model(score: DataFrame) -> DataFrame:
    """Of each person the scores of the model with feedback, if there are any, else the others."""
    full = F.max((F.col("model_type") == "feedbackIdentity").cast("int")).over(Window.partitionBy("person_id"))
    return score.withColumn("_full", full).filter((F.col("_full") == 0) | (F.col("model_type") == "feedbackIdentity")).drop("_full")


def infer_orcids(score: DataFrame, resolved: DataFrame, curation: DataFrame | None = None, threshold: float = 0.95) -> DataFrame:
    """The ORCID that each person's articles speak for, with confidence and tier.

    resolved: candidates with target. An article counts for or against by its decision (others are left out), or
    without `curation` by its score. Most accepted wins, then fewest rejected, then the smaller id.

    The candidates' ids are kept in the checkpoint folder before they are filtered: the optimizer would put the whole cascade
    that finds the author in place of each mention of the id in a condition, and run out of the driver's memory.
    """
    ids = written(resolved.select("person_id", "pmid", "first_name", "last_name", F.col("orcid").alias("identity_orcid"), normalize_orcid(F.coalesce("target.orcid", F.lit(""))).alias("id")))
    rows = best_model(score).join(ids.filter(F.length("id") >= 10), ["person_id", "pmid"])
    if curation is None:
        yes = F.col("calibrated_score") >= threshold
    else:
        rows = rows.join(curation.select("person_id", "pmid", "assertion"), ["person_id", "pmid"])
        yes = F.col("assertion") == "ACCEPTED"
    per = rows.groupBy("person_id", "first_name", "last_name", "identity_orcid", "id").agg(F.count_if(yes).alias("accepted_articles"), F.count_if(~yes).alias("rejected_articles"))
    person = Window.partitionBy("person_id")
    best = person.orderBy(F.desc("accepted_articles"), "rejected_articles", "id")
    one = per.withColumns({"n_distinct": F.count("*").over(person), "_rank": F.row_number().over(best)}).filter("_rank = 1")
    a, r, sole = F.col("accepted_articles"), F.col("rejected_articles"), F.col("n_distinct") == 1
    tier = F.when((a >= 5) & (r == 0) & sole, "confirmed").when((a >= 2) & (r == 0), "likely").when((a >= 1) & (r == 0), "possible").otherwise("unreliable")
    out = one.select(
        "person_id", "first_name", "last_name", F.col("id").alias("orcid"),
        half_even(wilson(a, r) / F.sqrt(F.col("n_distinct").cast("double")), 4).alias("confidence_score"),
        tier.alias("confidence_tier"), "accepted_articles", "rejected_articles", (a + r).alias("total_articles"), "identity_orcid",
        ((F.col("identity_orcid") != "") & (F.col("id") == normalize_orcid(F.col("identity_orcid")))).alias("orcid_matches_identity"),
    )
    return out.orderBy(F.desc("confidence_score"), "person_id")


def orcid_export(orcids: DataFrame) -> DataFrame:
    return orcids.withColumn("orcid_link", F.concat(F.lit("https://orcid.org/"), "orcid"))


def orcid_tiers(orcids: DataFrame) -> DataFrame:
    return orcids.groupBy("confidence_tier").agg(F.count("*").alias("persons"))


def pipeline_status(identity, article, link, score, curation, log: DataFrame | None = None, high: float = 0.95, unlikely: float = 0.30) -> DataFrame:
    """One row of totals; of scores also how many are high, unlikely and to review, and of pairs both scored and decided."""
    both = score.join(curation, ["person_id", "pmid"]).agg(F.count_distinct("person_id", "pmid").alias("assertions"))
    c = F.col("calibrated_score")
    scores = score.agg(
        F.count("*").alias("scores"), F.count_distinct("person_id").alias("scored_persons"), F.count_if(c >= high).alias("high"),
        F.count_if(c < unlikely).alias("unlikely"), F.count_if((c >= unlikely) & (c < high)).alias("review"),
    )
    links = link.agg(F.count_if(F.col("source") == "upload").alias("uploaded"), F.count_if(F.col("source") == "search").alias("searched"))
    out = identity.agg(F.count("*").alias("persons")).join(article.agg(F.count("*").alias("articles"))).join(links).join(scores).join(both)
    return out if log is None else out.join(log.agg(F.max("last_retrieval_date").alias("last_retrieval")))


def roster_counts(identity: DataFrame, link: DataFrame, score: DataFrame) -> DataFrame:
    """Persons with their numbers of linked and of scored articles, by last name."""
    n = link.groupBy("person_id").agg(F.count("*").alias("articles"))
    s = score.groupBy("person_id").agg(F.count_distinct("pmid").alias("scored"))
    rows = identity.select("person_id", "first_name", "last_name").join(n, "person_id", "left").join(s, "person_id", "left")
    return rows.na.fill(0, ["articles", "scored"]).orderBy("last_name", "first_name", "person_id")


def person_stats(link: DataFrame, curation: DataFrame) -> DataFrame:
    """Per person with links: total, accepted, rejected, pending, and accepted over decided."""
    rows = link.join(curation.select("person_id", "pmid", "assertion"), ["person_id", "pmid"], "left")
    is_ = lambda x: F.coalesce(F.col("assertion") == x, F.lit(False))
    out = rows.groupBy("person_id").agg(F.count("*").alias("total"), F.count_if(is_("ACCEPTED")).alias("accepted"), F.count_if(is_("REJECTED")).alias("rejected"))
    decided = F.greatest(F.col("accepted") + F.col("rejected"), F.lit(1))
    return out.withColumns({"pending": F.col("total") - F.col("accepted") - F.col("rejected"), "rate": F.col("accepted") / decided})


def article_summary(link: DataFrame, identity: DataFrame) -> DataFrame:
    per = link.groupBy("person_id").agg(F.count("*").alias("total"), F.count_if(F.col("source") == "upload").alias("uploaded"), F.count_if(F.col("source") == "search").alias("retrieved"))
    return per.join(identity.select("person_id", "first_name", "last_name"), "person_id", "left")


def scored_articles(score: DataFrame, article: DataFrame, curation: DataFrame) -> DataFrame:
    """Scored articles with their decision, the highest score first within a person."""
    rows = score.join(article.select("pmid", "journal", "pub_year"), "pmid").join(curation.select("person_id", "pmid", "assertion"), ["person_id", "pmid"], "left")
    return rows.withColumn("assertion", F.coalesce("assertion", F.lit(""))).orderBy("person_id", F.desc("calibrated_score"), "pmid")


def sort_choice(rows: DataFrame, by: str = "score", pending_first: bool = False) -> DataFrame:
    """by: score, year or journal; pending_first puts undecided articles before the others."""
    order = {"score": F.desc("calibrated_score"), "year": F.desc("pub_year"), "journal": F.asc("journal")}[by]
    return rows.orderBy(*([F.asc(F.col("assertion") != "")] if pending_first else []), order, "pmid")


def score_histogram(score: DataFrame, curation: DataFrame) -> DataFrame:
    """Per person and bin of a tenth: accepted, rejected and undecided articles."""
    rows = best_model(score).join(curation.select("person_id", "pmid", "assertion"), ["person_id", "pmid"], "left")
    place = F.least(F.lit(9), F.floor(F.col("calibrated_score") * 10)).cast("int")
    a = F.col("assertion")
    return rows.groupBy("person_id", place.alias("bin")).agg(F.count_if(a == "ACCEPTED").alias("accepted"), F.count_if(a == "REJECTED").alias("rejected"), F.count_if(a.isNull()).alias("uncurated"))


def score_bands(score: DataFrame, high: float = 0.95, low: float = 0.30) -> DataFrame:
    band = F.when(F.col("calibrated_score") >= high, "high").when(F.col("calibrated_score") >= low, "review").otherwise("unlikely")
    return score.groupBy("model_type", band.alias("band")).agg(F.count("*").alias("n"))


def score_summary(score: DataFrame) -> DataFrame:
    """One row: mean, exact median, how many over .5 and under .3."""
    c = F.col("calibrated_score")
    counts = score.agg(F.avg(c).alias("mean_score"), F.count_if(c > 0.5).alias("over_half"), F.count_if(c < 0.3).alias("under_third"))
    median = quantile(score, "calibrated_score", 0.5).select(F.col("calibrated_score").alias("median_score"))
    return counts.join(median, how="left")  # one row each


def equal_width_histogram(score: DataFrame, bins: int = 10) -> DataFrame:
    """Counts in bins of equal width between the least and the highest score."""
    ends = score.agg(F.min("calibrated_score").alias("lo"), F.max("calibrated_score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("calibrated_score") - F.col("lo")) / width)))
    return score.join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def completeness(identity: DataFrame) -> DataFrame:
    """One row: persons, filled ones of their six signals, and the percentage."""
    text = [(F.col(c) != "").cast("int") for c in ("middle_name", "primary_email", "primary_institution", "department", "orcid")]
    filled = sum(text, (F.col("doctoral_year") > 0).cast("int"))
    one = identity.agg(F.count("*").alias("persons"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"))
    return one.withColumn("percent", F.when(F.col("persons") > 0, F.col("filled") * 100 / (F.col("persons") * 6)).otherwise(0.0))


def training_overview(curation: DataFrame) -> DataFrame:
    a = F.col("assertion")
    return curation.agg(F.count_distinct("person_id").alias("persons"), F.count("*").alias("total"), F.count_if(a == "ACCEPTED").alias("accepted"), F.count_if(a == "REJECTED").alias("rejected"))


def bulk_curation(score: DataFrame, curation: DataFrame, threshold: float = 0.9) -> DataFrame:
    """New decisions for undecided articles: accepted from the threshold on, rejected under one less it."""
    c = F.col("calibrated_score")
    mark = F.when(c >= threshold, "ACCEPTED").when(c < 1 - threshold, "REJECTED")
    rows = best_model(score).join(curation, ["person_id", "pmid"], "left_anti")
    return rows.select("person_id", "pmid", mark.alias("assertion")).filter("assertion is not null")


def with_status(cand: DataFrame, *keep: str, limit: int | None = None) -> DataFrame:
    """status: the decision, or PENDING; only the kept ones, `limit` of them for a page."""
    rows = cand.withColumn("status", F.when(F.col("assertion") == "", "PENDING").otherwise(F.col("assertion")))
    rows = rows.filter(F.col("status").isin(*keep)) if keep else rows
    return rows if limit is None else rows.orderBy("person_id", "pmid").limit(limit)


def run_summary(link: DataFrame, score: DataFrame) -> DataFrame:
    """Per person: linked and scored articles, least and highest score, and whether any was scored."""
    s = best_model(score).groupBy("person_id").agg(F.count("*").alias("scored_count"), F.min("calibrated_score").alias("min_score"), F.max("calibrated_score").alias("max_score"))
    n = link.groupBy("person_id").agg(F.count("*").alias("article_count"))
    return n.join(s, "person_id", "left").na.fill(0, ["scored_count"]).withColumn("succeeded", F.col("scored_count") > 0)


def run_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count_if("succeeded").alias("succeeded"), F.count_if(~F.col("succeeded")).alias("failed"), F.count("*").alias("total"))


def curation_counts(curation: DataFrame) -> DataFrame:
    return curation.groupBy("person_id").pivot("assertion", ["ACCEPTED", "REJECTED"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"ACCEPTED": "accepted", "REJECTED": "rejected"})


def article_listing(cand: DataFrame, title: int = 80, journal: int = 40, limit: int | None = 50) -> DataFrame:
    """A page of articles with title and journal cut short; limit None lists all."""
    rows = with_status(cand).select("person_id", "pmid", F.substring("title", 1, title).alias("title"), F.substring("journal", 1, journal).alias("journal"), "pub_year", "status")
    rows = rows.orderBy("person_id", F.desc("pub_year"), F.desc("pmid"))
    return rows if limit is None else rows.limit(limit)


def dashboard_totals(identity: DataFrame, article: DataFrame, curation: DataFrame) -> DataFrame:
    return identity.agg(F.count("*").alias("researchers")).join(article.agg(F.count("*").alias("articles"))).join(curation.agg(F.count("*").alias("curated")))


def identities(identity: DataFrame, person: str | None = None) -> DataFrame:
    return (identity if person is None else identity.filter(F.col("person_id") == person)).orderBy("last_name", "first_name", "person_id")


def pmid_lists(link: DataFrame) -> DataFrame:
    """Per person its pmids in order; a person's links are bounded by the retrieval thresholds."""
    return link.groupBy("person_id").agg(F.array_sort(F.collect_set("pmid")).alias("pmids"))


def run_backfill(score: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A run 1 made up from scores without one, and the scores with their run_id filled in. Takes scored_at and run_id."""
    run = score.agg(F.lit(1).alias("run_id"), F.min("scored_at").alias("started_at"), F.max("scored_at").alias("completed_at"), F.count_distinct("person_id").alias("total"))
    return run, score.withColumn("run_id", F.coalesce("run_id", F.lit(1)))


def score_export(score: DataFrame, article: DataFrame, identity: DataFrame, person: str | None = None, threshold: float = 0.0) -> DataFrame:
    """Scores in per cent to one place, from the threshold on as rounded, with names and link; text is guarded."""
    rows = score if person is None else score.filter(F.col("person_id") == person)
    rows = rows.join(article.select("pmid", "journal", "pub_year"), "pmid").join(identity.select("person_id", "first_name", "last_name"), "person_id")
    rows = rows.withColumn("score", percent(F.col("calibrated_score"), 1)).filter(F.col("score") >= threshold)
    link = F.concat(F.lit(ARTICLE_LINK), F.col("pmid").cast("string"), F.lit("/"))
    text = [guard_cell(F.col(c)).alias(c) for c in ("person_id", "first_name", "last_name")]
    return rows.select(*text, "pmid", guard_cell(F.col("journal")).alias("journal"), "pub_year", "model_type", "score", link.alias("link")).orderBy("person_id", F.desc("score"), "pmid")


def full_export(resolved: DataFrame, score: DataFrame) -> DataFrame:
    """Every candidate with its target author, number of authors, score if there is one, and status."""
    best = best_model(score).select("person_id", "pmid", "model_type", "calibrated_score")
    rows = with_status(resolved).join(best, ["person_id", "pmid"], "left")
    name = F.trim(F.concat_ws(" ", "target.first_name", "target.last_name"))
    return rows.select("person_id", "pmid", "journal", "pub_year", name.alias("target_author"), (F.col("target_author_index") + 1).alias("target_rank"), F.size("authors").alias("author_count"), "model_type", "calibrated_score", "status")


def curation_export(curation: DataFrame) -> DataFrame:
    return curation.select("person_id", "pmid", "assertion").orderBy("person_id", "pmid")
