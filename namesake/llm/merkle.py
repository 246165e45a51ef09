"""A Merkle manifest of a table: hashes of rows, of runs of 16 nodes, of sources, and the proofs of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, materialize
from .line_dedup import lower_ascii

FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """H of a row: each field as its UTF-8 byte count, a colon and its value, or - if null."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with lo (place in their group g by `order`, from 0, gapless), hi (lo + 1) and n (rows of the group), and the
    number of levels over the largest group.

    The rows are cut into ranges of (group, *order) and sorted, so a group of any size lies over many tasks; a range's place
    in its group is moved up by what the ranges before hold. Equal rows are interchangeable; a last number parts them,
    so that many equal rows don't make one range. `rows` must be cheap to read twice: Spark samples them first.
    """
    keys = ["g", *order, "_tie"]
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_rows = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    table = materialize(sorted_rows)
    part, at = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = table.groupBy("g", part.alias("_part")).agg(F.min(at).alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("g", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_rows").over(whole).alias("n"))
    placed = table.withColumn("_part", part).join(starts, ["g", "_part"]).withColumn("lo", F.col("_start") + at)
    levels, most = 0, starts.agg(F.max("n")).first()[0] or 0
    while FAN**levels < most:
        levels += 1
    return placed.withColumn("hi", F.col("lo") + 1).drop("_part", "_start", "_at"), levels


def climb(leaves: DataFrame, levels: int, *carried: str) -> list[DataFrame]:
    """The levels above the leaves, one at least, each with nodes (g, n, lo, hi, h, kids): the interval of leaf ranks that
    a node covers, its hash and its children in order. The children on the lowest level are leaves with the carried columns.

    A node of level k covers FAN**k ranks, or what is left of them. A group whose nodes have become one climbs on
    unchanged (its lone node is its own parent), so that all groups reach the same level.
    """
    out, below = [], leaves
    for level in range(1, max(1, levels) + 1):
        kid = F.struct("lo", "hi", "h", *(carried if level == 1 else ()))
        runs = below.groupBy("g", "n", F.floor(F.col("lo") / F.lit(FAN**level)).alias("run")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        h = F.when(F.col("n") <= FAN ** (level - 1), F.col("kids")[0]["h"]).otherwise(digest(F.array_join("kids.h", "")))
        below = materialize(runs.select("g", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), h.alias("h"), "kids"))
        out.append(below)
    return out


def siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """struct(left, right): hashes of the children whose intervals lie in their parent's, but before or after [lo, hi)."""
    left = F.array_join(F.transform(F.filter(kids, lambda k: k["hi"] <= lo), lambda k: k["h"]), "")
    right = F.array_join(F.transform(F.filter(kids, lambda k: k["lo"] >= hi), lambda k: k["h"]), "")
    return F.struct(left.alias("left"), right.alias("right"))


def descend(levels: list[DataFrame], top: DataFrame, *kept: str) -> DataFrame:
    """(g, kid, path, *kept) of each leaf: the siblings of the leaf, of its parent, and so on to the group's top, followed by
    the path that `top` (g, path, *kept) has for the group.

    Each level's nodes meet their parents by containment: the parent's interval covers the child's. A level's intervals
    have the same width, so the bucket lo / width of a child names the one parent that can cover it.
    """
    above = levels[-1].join(top, "g")
    for level in range(len(levels), 0, -1):
        own = siblings(F.col("kids"), F.col("kid.lo"), F.col("kid.hi"))
        # A lone node that has climbed on unchanged isn't hashed again on this level.
        path = F.when(F.col("n") > FAN ** (level - 1), F.concat(F.array(own), "path")).otherwise(F.col("path"))
        kids = above.select("g", "n", "path", "kids", *kept, F.explode("kids").alias("kid")).select("g", "kid", path.alias("path"), *kept)
        if level > 1:
            width = F.lit(FAN ** (level - 1))
            parents = kids.select("g", F.floor(F.col("kid.lo") / width).alias("bucket"), F.col("kid.lo").alias("from"), F.col("kid.hi").alias("to"), "path", *kept)
            met = levels[level - 2].withColumn("bucket", F.floor(F.col("lo") / width)).join(parents, ["g", "bucket"])
            above = met.filter((F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to")))
    return kids


def prove(docs: DataFrame, tampered: dict[str, Column], where: Column) -> DataFrame:
    """Each row's place in the manifest and its proof, and what the proof gives for the row as it is or, where `where` holds,
    with fields changed as in `tampered`.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Leaves of a source ascend by doc_id (null
    first), equal ids by the leaf's hash, so repeated rows get places of their own; null is a source of its own, the first.
    Texts of any length, empty ones too, are hashed whole; a null field counts as -. Columns other than FIELDS aren't read.
    An empty table has no rows and no root.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select("doc_id", source.alias("g"), leaf().alias("h"), F.when(where, leaf(**tampered)).alias("t"))
    leaves, height = ranked(materialize(rows), ["doc_id", "h"])
    levels = climb(leaves, height, "t", "doc_id")
    # The tree over the sources is of the same kind, over one group; its leaves are the subroots.
    subroots, height = ranked(materialize(levels[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "h")), ["source"])
    over = climb(subroots, height, "source")
    nowhere = F.array().cast("array<struct<left:string,right:string>>")
    tops = descend(over, over[-1].select("g", nowhere.alias("path"), F.col("h").alias("root")), "root")
    tops = tops.select(F.col("kid.source").alias("g"), "path", F.col("kid.h").alias("subroot"), "root")
    found = descend(levels, tops, "subroot", "root")
    proof = digest(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""))
    folded = F.aggregate("path", F.coalesce("kid.t", "kid.h"), lambda h, p: digest(F.concat(p["left"], h, p["right"])))
    result = found.select("kid.doc_id", F.col("kid.h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


def report(docs: DataFrame) -> DataFrame:
    """The proofs, with A-Z of the text in lower case where the id's crc32 leaves no remainder by 5 (a null id: empty text)."""
    return prove(docs, {"text": lower_ascii(F.col("text"))}, held_out(F.col("doc_id"), 5, 0))
