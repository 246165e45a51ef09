"""What addresses of articles tell about an institution: its e-mail domains and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.strings import EMAIL, keywords_of


def affiliations(article: DataFrame, domain: str, years: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """All authors' addresses of the articles of which one has the domain; limit takes the newest articles only."""
    rows = article.filter(F.exists("authors", lambda a: F.lower(a["affiliation"]).contains(domain.lower())))
    if years is not None:
        rows = rows.filter(F.col("pub_year").between(*years))
    if limit is not None:
        rows = rows.orderBy(F.desc("pub_year"), F.desc("pmid")).limit(limit)
    return rows.select(F.explode("authors.affiliation").alias("affiliation")).filter("affiliation <> ''")


def email_domains(texts: DataFrame, column: str = "affiliation", k: int | None = 10) -> DataFrame:
    """(domain, n): domains of addresses in the texts, the k commonest; None gives all."""
    found = texts.select(F.explode(F.regexp_extract_all(column, F.lit(EMAIL), F.lit(1))).alias("domain"))
    out = found.groupBy(F.regexp_replace(F.lower("domain"), r"\.+$", "").alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")
    return out if k is None else out.limit(k)


def institution_names(texts: DataFrame, column: str = "affiliation", k: int | None = 20) -> DataFrame:
    """(name, n, keywords): parts of addresses, between commas, that name an institution; the k commonest."""
    parts = texts.select(F.explode(F.split(column, ",")).alias("name")).select(F.trim("name").alias("name"))
    kind = F.lower("name").rlike("|".join(params.GENERIC_WORDS))
    kept = parts.filter(~F.col("name").rlike(params.LOCATION) & ~F.col("name").contains("@") & kind & (F.length("name") > 5))
    out = kept.groupBy("name").agg(F.count("*").alias("n")).withColumn("keywords", keywords_of(F.col("name"))).orderBy(F.desc("n"), "name")
    return out if k is None else out.limit(k)


def classify(names: DataFrame, home: int = 2, least: int = 5) -> DataFrame:
    """The first `home` of the commonest names are home, the rest collaborating; shown: seen `least` times."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "name"))  # of the k names of a report
    return names.withColumns({"role": F.when(rank <= home, "home").otherwise("collaborating"), "shown": F.col("n") >= least})
