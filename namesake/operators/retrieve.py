"""Finding candidate articles: a join of the roster with an index of authors, guarded by counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import name_key, normalize_orcid, strip
from ..params import Params
from .order import written

KEYS = ["person_id", "pmid"]
KINDS = ("lenient", "strict", "orcid")
DATES = ("entry_date", "pub_date")


def _keys(rows: DataFrame, *others: Column | str) -> DataFrame:
    """The lenient key (last name and first initial) and the strict one (last and first name), '' without a last name, the ORCID
    and other columns. The parts of the keys are columns of their own, so that each is made once a row."""
    l, f = F.col("_l"), F.col("_f")  # noqa: E741
    orcid = F.coalesce("orcid", F.lit("")) if "orcid" in rows.columns else F.lit("")
    rows = rows.select(*others, name_key(F.col("last_name")).alias("_l"), name_key(F.col("first_name")).alias("_f"), strip(orcid).alias("_o"))
    lenient = F.when(l == "", "").when(f == "", l).otherwise(F.concat_ws(" ", l, F.substring(f, 1, 1)))
    strict = F.when(l == "", "").when(f == "", l).otherwise(F.concat_ws(" ", l, f))
    bare = F.when(F.col("_o").contains("/") | F.col("_o").contains(" "), normalize_orcid(F.col("_o"))).otherwise(F.col("_o"))
    return rows.select(*others, lenient.alias("lenient"), strict.alias("strict"), bare.alias("orcid"))


def author_index(article: DataFrame) -> DataFrame:
    """(pmid, lenient, strict, orcid, dates) of each listed author; only the fields of the join are read. Takes articles with
    their lists of authors, or a row for each author, which needs no lists."""
    dates = [c for c in DATES if c in article.columns]
    rows = article.select("pmid", *dates, F.explode("authors").alias("a")).select("pmid", *dates, "a.*") if "authors" in article.columns else article
    return _keys(rows, "pmid", *dates)


def matches(identity: DataFrame, index: DataFrame, dated: bool = False) -> tuple[DataFrame, DataFrame]:
    """The roster's name keys and ORCIDs with a number each (kind, key, key_id), and (pmid, key_id) of the index, once each
    and if dated with the latest of its dates.

    The articles are read once, for all steps of the search: what is kept in the checkpoint folder is only what the roster
    asks for. A roster that fits a broadcast is one; else names as common as they come are split by Spark, since the rows
    move on by article. From there on numbers are compared, not names.
    """
    keys = written(_wanted(identity).select("kind", "key").distinct().withColumn("key_id", F.monotonically_increasing_id()))
    dates = [c for c in DATES if dated and c in index.columns]
    rows = index.select("pmid", *dates, _entries(*KINDS)).filter("key <> ''").join(keys, ["kind", "key"]).select("pmid", "key_id", *dates)
    once = rows.repartition("pmid").groupBy("pmid", "key_id").agg(*[F.max(c).alias(c) for c in dates]) if dates else rows.repartition("pmid").distinct()
    return keys, written(once)


def _entries(*kinds: str) -> Column:
    """A row (kind, key) for each kind's column."""
    return F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in kinds]))


def _people(identity: DataFrame) -> DataFrame:
    return _keys(identity, "person_id")


def _wanted(identity: DataFrame, *kinds: str) -> DataFrame:
    """(person_id, kind, key) of the roster."""
    return _people(identity).select("person_id", _entries(*(kinds or KINDS))).filter("key <> ''")


def _decisions(identity: DataFrame, keys: DataFrame, matched: DataFrame, cfg: Params) -> DataFrame:
    """person_id, query_type, lenient_count, strict_count and the numbers of the two keys, null where nothing has them."""
    counts = matched.groupBy("key_id").agg(F.count("*").alias("n")).join(keys, "key_id")
    of = lambda kind: counts.filter(F.col("kind") == kind).select(F.col("key").alias(kind), F.col("n").alias(f"n_{kind}"), F.col("key_id").alias(f"{kind}_id"))
    tried = _people(identity).join(of("lenient"), "lenient", "left").join(of("strict"), "strict", "left").na.fill(0, ["n_lenient"])
    over = F.col("n_lenient") > cfg.lenient_threshold
    strict_count = F.when(over, F.coalesce("n_strict", F.lit(0)))
    kind = F.when(~over, "lenient").when(strict_count <= cfg.strict_threshold, "strict").otherwise("skipped")
    return tried.select("person_id", kind.alias("query_type"), F.col("n_lenient").alias("lenient_count"), strict_count.alias("strict_count"), "lenient_id", "strict_id")


def _asked(decisions: DataFrame) -> DataFrame:
    """(person_id, key_id): the one name key of each person that is searched for, if any article has it."""
    key = F.when(F.col("query_type") == "lenient", F.col("lenient_id")).when(F.col("query_type") == "strict", F.col("strict_id"))
    return decisions.select("person_id", key.alias("key_id")).filter("key_id is not null")


def retrieve_by_name(identity: DataFrame, index: DataFrame, cfg: Params | None = None) -> tuple[DataFrame, DataFrame]:
    """(person_id, pmid) found by name, and the decision per person: query_type, lenient_count, strict_count.

    Keys are counted before anything is joined: a person whose lenient key has too many articles falls back on the
    strict one, or is skipped, so that the commonest names never reach the join.
    """
    keys, matched = matches(identity, index)
    decisions = _decisions(identity, keys, matched, cfg or Params())
    return matched.join(_asked(decisions), "key_id").select(*KEYS), decisions.drop("lenient_id", "strict_id")


def retrieve_by_orcid(identity: DataFrame, index: DataFrame) -> DataFrame:
    """(person_id, pmid) of articles that list the person's ORCID; no thresholds."""
    found = index.select("pmid", "orcid").filter("orcid <> ''").join(_wanted(identity, "orcid").select("person_id", F.col("key").alias("orcid")), "orcid")
    return found.select(*KEYS).distinct()


def since(index: DataFrame, first_day: Column) -> Column:
    """Entered or published on the day or later: records that were indexed late aren't lost."""
    return (F.col("entry_date") >= first_day) | (F.col("pub_date") >= first_day)


def retrieve(identity: DataFrame, article: DataFrame, link: DataFrame, log: DataFrame | None = None, mode: str = "full", cfg: Params | None = None) -> DataFrame:
    """(person_id, pmid, source) of new candidates, by name or ORCID, without the pairs that are linked already.

    mode full takes all articles, update those since the person's last retrieval (all for a first one, and all by ORCID
    until an ORCID retrieval has been made), score_only none. Name keys and ORCIDs are found by one join. The found pairs,
    of which there may be far more than articles, are the last thing made: links, and pairs that would come by name
    and by ORCID, are set out beside the articles' keys before.
    """
    if mode == "score_only":
        source = T.StructField("source", T.StringType(), False)
        return identity.sparkSession.createDataFrame([], T.StructType([identity.schema["person_id"], article.schema["pmid"], source]))
    update = mode == "update" and log is not None
    keys, matched = matches(identity, author_index(article), update)
    names = _asked(_decisions(identity, keys, matched, cfg or Params())).distinct()
    orcids = _wanted(identity, "orcid").join(keys, ["kind", "key"]).select("person_id", "key_id").distinct()
    if update:
        day = lambda rows, c: rows.join(log.select("person_id", F.col(c).alias("day")), "person_id", "left")
        names, orcids = day(names, "last_retrieval_date"), day(orcids, "last_orcid_retrieval_date")
    asked = names.unionByName(orcids)

    def found(rows: DataFrame, asked: DataFrame) -> DataFrame:
        pairs = rows.join(asked, "key_id")
        return pairs.filter(F.col("day").isNull() | since(pairs, F.col("day"))) if update else pairs

    # a person has one name key at most and one ORCID: a pair comes twice only where an article has both
    both = found(matched, names.join(orcids.select("person_id", F.col("key_id").alias("orcid_id")), "person_id"))
    twice = both.select("person_id", "pmid", F.col("orcid_id").alias("key_id")).join(matched.select("pmid", "key_id"), ["pmid", "key_id"], "left_semi")
    linked = link.select(*KEYS).join(asked.select("person_id", "key_id"), "person_id")
    gone = linked.unionByName(twice).groupBy("pmid", "key_id").agg(F.collect_set("person_id").alias("gone"))
    rows = matched.join(asked.select("key_id").distinct(), "key_id", "left_semi").join(gone, ["pmid", "key_id"], "left")
    pairs = found(rows, asked).filter(F.col("gone").isNull() | ~F.array_contains("gone", F.col("person_id")))
    return pairs.select(*KEYS, F.lit("search").alias("source"))
