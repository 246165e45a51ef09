"""Which listed author is the person: a cascade of rules, the first that finds one author wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import email_user, first_initial, first_or, name_key, parts_of


def _words(a: Column, fore_name: bool) -> Column:
    """The given name of a listed author, its words and the second initial. With fore_name the whole given name is split, else
    only its first word is known."""
    given = F.coalesce(a["fore_name"] if fore_name else a["first_name"], F.lit(""))
    second = F.when(F.length(a["initials"]) > 1, F.lower(F.substring(a["initials"], 2, 1)))
    return F.struct(given.alias("given"), parts_of(given).alias("words"), second.alias("second"), a["last_name"].alias("last"), a["initials"].alias("initials"), a["affiliation"].alias("affiliation"))


def _keys(w: Column) -> Column:
    """Keys of a listed author, of its words."""
    given, words, second, several = w["given"], w["words"], w["second"], F.size(w["words"]) > 1
    rest = F.when(several, name_key(F.array_join(F.slice(words, 2, 1000), " "))).otherwise("")
    key = name_key(given)
    return F.struct(
        key.alias("first"),
        F.when(several, name_key(F.get(words, F.lit(0)))).otherwise(key).alias("token"),
        rest.alias("rest"),
        several.alias("several"),
        F.coalesce(second, F.lit("")).alias("second"),
        F.coalesce(second, F.when(several, first_initial(F.get(words, F.lit(1)))), F.lit("")).alias("middle_initial"),
        F.when(rest != "", rest).otherwise(F.coalesce(second, F.lit(""))).alias("middle"),
        (second.isNull() & several).alias("cut"),
        name_key(w["last"]).alias("last"),
        first_or(given, w["initials"]).alias("initial"),
        first_initial(given).alias("given_initial"),
        first_initial(w["last"]).alias("last_initial"),
        F.lower(F.coalesce(w["affiliation"], F.lit(""))).alias("affiliation"),
    )


PERSON = ("first", "last", "middle", "fi", "mi", "li", "email", "user")


def _person() -> dict[str, Column]:
    values = [name_key(F.col("first_name")), name_key(F.col("last_name")), name_key(F.col("middle_name"))]
    values += [first_initial(F.col("first_name")), first_initial(F.col("middle_name")), first_initial(F.col("last_name"))]
    values += [F.lower("primary_email"), email_user(F.col("primary_email"))]
    return dict(zip(PERSON, values))


def _points(a: Column, p: dict[str, Column]) -> Column:
    """How well an author fits the person among several with equal names or initials."""
    name = F.when((F.length(a["first"]) > 1) & (a["first"] == p["first"]), 3).when(a["given_initial"] == p["fi"], 1).otherwise(0)
    mid = F.when(p["middle"] == "", 0).when((F.length(a["middle"]) > 1) & (a["middle"] == p["middle"]), 2)
    mid = mid.when((a["middle"] != "") & (F.substring(a["middle"], 1, 1) == F.substring(p["middle"], 1, 1)), 1).otherwise(0)
    return name + mid


def _rules(p: dict[str, Column]) -> list[tuple]:
    """(kind, rule of an author, guard of the person) in the order in which they are tried. Of several authors who fit, kind
    'only' takes none, 'best' the one with the most points, if there is one, and 'first' the first."""
    same_last = lambda a: a["last"] == p["last"]
    length = F.length

    def near(a: Column) -> Column:
        d = F.levenshtein(a["last"], p["last"], 2)
        return (length(a["last"]) >= 4) & (d > 0) & ((a["initial"] == p["fi"]) | ((length(a["first"]) > 1) & (a["first"] == p["first"])))

    def addressed(a: Column) -> Column:
        return (a["affiliation"] != "") & (a["affiliation"].contains(p["email"]) | ((p["user"] != "") & a["affiliation"].contains(p["user"])))

    return [
        ("only", lambda a: same_last(a) & (F.when(a["several"], a["token"]).otherwise(a["first"]) == p["first"]) & (F.when(a["several"], a["rest"]).otherwise("") == p["middle"]), p["middle"] != ""),
        ("only", lambda a: same_last(a) & (F.when(a["cut"], a["token"]).otherwise(a["first"]) == p["first"]) & (a["middle_initial"] == p["mi"]), p["mi"] != ""),
        ("best", lambda a: same_last(a) & (a["first"] == p["first"]), None),
        ("only", lambda a: same_last(a) & p["first"].startswith(a["first"]) & (length(a["first"]) > 1), length(p["first"]) > 1),
        ("only", lambda a: same_last(a) & (a["first"] != "") & a["first"].startswith(p["first"]), length(p["first"]) > 1),
        ("best", lambda a: same_last(a) & (a["initial"] == p["fi"]), p["fi"] != ""),
        ("first", addressed, p["email"] != ""),
        ("only", lambda a: same_last(a) & (a["initial"] == p["mi"]) & (a["second"] == p["fi"]), (p["fi"] != "") & (p["mi"] != "")),
        ("only", lambda a: a["last"].contains(p["last"]) & (a["initial"] == p["fi"]), (p["fi"] != "") & (length(p["last"]) > 2)),
        ("only", same_last, None),
        ("only", lambda a: a["first"] == p["first"], length(p["first"]) > 1),
        ("only", lambda a: (length(a["last"]) > 1) & p["last"].contains(a["last"]), length(p["last"]) > 3),
        ("only", lambda a: (a["first"] == p["first"]) & (a["last_initial"] == p["li"]), length(p["first"]) > 1),
        ("only", lambda a: (a["last"] == p["middle"]) & (a["initial"] == p["fi"]), length(p["middle"]) > 1),
        ("only", lambda a: (a["first"] == p["last"]) & (a["last"] == p["first"]), (length(p["first"]) > 1) & (length(p["last"]) > 1)),
        ("only", lambda a: (length(a["first"]) > 1) & (a["first"] == p["last"]) & (a["last_initial"] == p["fi"]), length(p["last"]) > 1),
        ("only", lambda a: (a["initial"] == p["fi"]) & (a["last_initial"] == p["li"]), p["fi"] != ""),
        ("only", near, length(p["last"]) >= 4),
    ]


#: The most points that break a tie: three for the first name, two for the middle one.
MOST_POINTS = 5


def resolve_by_groups(cand: DataFrame, fore_name: bool = False) -> DataFrame:
    """(person_id, pmid, target_author_index) as resolve_target_author() finds it, of different pairs of person and article.

    One row per author, whose keys and rules are plain columns and so compiled; a number per author has a bit for
    each rule it fits. One group per candidate counts the authors of each rule, and of the two rules with ties those
    of each number of points; the first rule with one author wins.
    """
    keys = [v.alias(f"p_{k}") for k, v in _person().items()]
    rows = cand.select("person_id", "pmid", "authors", *keys)
    rows = rows.select("person_id", "pmid", *[f"p_{k}" for k in PERSON], F.posexplode("authors").alias("i", "author"))
    rows = rows.withColumn("w", _words(F.col("author"), fore_name)).withColumn("a", _keys(F.col("w")))
    p, a = {k: F.col(f"p_{k}") for k in PERSON}, F.col("a")
    rules = _rules(p)
    mask = None
    for k, (_, rule, guard) in enumerate(rules):
        bit = F.when(rule(a) if guard is None else guard & rule(a), 1 << k).otherwise(0)
        mask = bit if mask is None else mask + bit
    marked = rows.select("person_id", "pmid", "i", mask.alias("mask"), _points(a, p).alias("points"))
    fits = lambda k: F.col("mask").bitwiseAND(1 << k) > 0
    sums = []
    for k, (kind, _, _) in enumerate(rules):
        sums += [F.count_if(fits(k)).alias(f"n{k}"), F.min(F.when(fits(k), F.col("i"))).alias(f"i{k}")]
        for s in range(1, MOST_POINTS + 1) if kind == "best" else ():
            at = fits(k) & (F.col("points") == s)
            sums += [F.count_if(at).alias(f"n{k}_{s}"), F.min(F.when(at, F.col("i"))).alias(f"i{k}_{s}")]
    groups = marked.groupBy("person_id", "pmid").agg(*sums)
    steps = []
    for k, (kind, _, _) in enumerate(rules):
        n, i = F.col(f"n{k}"), F.col(f"i{k}")
        if kind == "first":
            steps.append(i)
        elif kind == "only":
            steps.append(F.when(n == 1, i))
        else:
            step = F.when(n == 1, i)
            for s in range(MOST_POINTS, 0, -1):
                here = F.col(f"n{k}_{s}")
                step = step.when(here == 1, F.col(f"i{k}_{s}")).when(here > 1, F.lit(None))
            steps.append(step)
    found = groups.select("person_id", "pmid", F.coalesce(*steps, F.lit(-1)).cast("int").alias("target_author_index"))
    none = F.coalesce("target_author_index", F.lit(-1)).alias("target_author_index")
    return cand.select("person_id", "pmid").join(found, ["person_id", "pmid"], "left").select("person_id", "pmid", none)


def resolve_target_author(cand: DataFrame, fore_name: bool = False) -> DataFrame:
    """Add target_author_index (from 0; -1: none).

    Map-only: authors' keys are made once, and of each author one number with a bit for each rule it fits. From these the
    bits that some author has, and that several have, give the first rule with an author; most candidates need no more.
    Each rule counts only if exactly one author fits; the rules for equal names and for equal initials break ties by points,
    and the e-mail rule takes the first author whose address has it. fore_name uses the whole given name where the
    articles have it.
    """
    keys = {f"_p_{k}": _person()[k] for k in PERSON}
    p = {k: F.col(f"_p_{k}") for k in PERSON}
    rules = _rules(p)

    def mask(a: Column) -> Column:
        bits = [F.when(rule(a) if guard is None else guard & rule(a), 1 << k).otherwise(0) for k, (_, rule, guard) in enumerate(rules)]
        return reduce(lambda x, y: x + y, bits)

    rows = cand.withColumns(keys | {"_a": F.transform(F.transform("authors", lambda a: _words(a, fore_name)), _keys)})
    rows = rows.withColumn("_m", F.transform("_a", mask))
    none = F.struct(F.lit(0).alias("some"), F.lit(0).alias("several"))
    seen = F.aggregate("_m", none, lambda s, m: F.struct(s["some"].bitwiseOR(m).alias("some"), s["several"].bitwiseOR(s["some"].bitwiseAND(m)).alias("several")))
    rows = rows.withColumn("_seen", F.coalesce(seen, none))

    def best(k: int) -> Column:
        """The author with the most points among those who fit, if only one has as many."""
        fits = F.filter(F.transform(F.arrays_zip("_m", "_a"), lambda x, i: F.struct(_points(x["_a"], p).alias("s"), i.alias("i"), x["_m"].bitwiseAND(1 << k).alias("fits"))), lambda x: x["fits"] > 0)
        top = F.array_max(F.transform(fits, lambda x: x["s"]))
        winners = F.filter(fits, lambda x: x["s"] == top)
        return F.when((top > 0) & (F.size(winners) == 1), F.get(winners, F.lit(0))["i"])

    steps = []
    for k, (kind, _, _) in enumerate(rules):
        some, several = (F.col(f"_seen.{c}").bitwiseAND(1 << k) > 0 for c in ("some", "several"))
        first = F.array_position(F.transform("_m", lambda m: m.bitwiseAND(1 << k)), 1 << k).cast("int") - 1  # noqa: B023
        step = F.when(some if kind == "first" else some & ~several, first)
        steps.append(step.when(several, best(k)) if kind == "best" else step)
    index = F.coalesce(*steps, F.lit(-1)).cast("int")
    return rows.withColumn("target_author_index", index).drop(*keys, "_a", "_m", "_seen")


def with_target(cand: DataFrame) -> DataFrame:
    """Add the struct target, the author at target_author_index (null: none)."""
    return cand.withColumn("target", F.when(F.col("target_author_index") >= 0, F.get("authors", F.col("target_author_index"))))
