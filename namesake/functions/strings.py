"""Column functions over names and addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params

EMAIL = r"[\p{L}\p{N}_.+-]+@([\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+)"

WHITE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def name_key(c: Column) -> Column:
    """For finding the author: lower case, without . - and '."""
    return strip(F.translate(F.lower(c), ".-'", ""))


def score_key(c: Column) -> Column:
    """For scoring names: lower case, without . and ', hyphens as spaces."""
    return strip(F.translate(F.lower(c), "-.'", " "))


def first_initial(c: Column) -> Column:
    return F.lower(F.substring(c, 1, 1))


def first_or(c: Column, initials: Column) -> Column:
    """The first initial, of the initials where there is no name."""
    return F.when(c != "", first_initial(c)).otherwise(first_initial(initials))


def strip_suffixes(c: Column, suffixes: list[str] = params.SUFFIXES) -> Column:
    """Without trailing titles: each of the list in turn, first after a comma, then after a space."""

    def cut(name: Column, end: Column) -> Column:
        return F.when(F.endswith(F.lower(name), end), strip(F.substr(name, F.lit(1), F.length(name) - F.length(end)))).otherwise(name)

    return F.aggregate(F.array(*[F.lit(f"{sep}{x}".lower()) for x in suffixes for sep in (", ", " ")]), c, cut)


def parts_of(c: Column) -> Column:
    """The words of a name."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def email_user(c: Column) -> Column:
    return F.lower(F.when(c.contains("@"), F.substring_index(c, "@", 1)).otherwise(F.lit("")))


def email_domain(c: Column) -> Column:
    return F.lower(F.when(c.contains("@"), F.element_at(F.split(c, "@"), 2)).otherwise(F.lit("")))


def domain_in(c: Column) -> Column:
    """The domain of the first address in a text, '' if it has none."""
    return F.lower(F.regexp_extract(c, EMAIL, 1))


def normalize_orcid(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"https?://(www\.)?orcid\.org/|[ /]", "")


def keyword_match(text: Column, groups: list[str]) -> Column:
    """Whether the text has all words of one of the groups, whose words are parted by |."""
    low = F.lower(text)
    hits = [reduce(lambda a, b: a & b, [low.contains(w.strip().lower()) for w in g.split("|")]) for g in groups]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def keywords_of(name: Column) -> Column:
    """Up to four telling words of an institution's name, parted by |."""
    words = parts_of(F.lower(name))
    plain = F.filter(words, lambda w: ~w.isin(params.STOPWORDS))
    telling = F.filter(plain, lambda w: ~w.isin(params.GENERIC_WORDS))
    return F.array_join(F.slice(F.when(F.size(telling) > 0, telling).otherwise(plain), 1, 4), "|")


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def wilson_clipped(accepted: Column, rejected: Column) -> Column:
    """Lower bound of the share of accepted at 95 per cent; 0.5 without any."""
    n, z = (accepted + rejected).cast("double"), 1.959963984540054
    p = accepted / n
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), low))).otherwise(0.5)


def wilson(accepted: Column, rejected: Column) -> Column:
    """Lower bound with z = 1.96; 0 without any."""
    n, z = (accepted + rejected).cast("double"), 1.96
    p = accepted / n
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, low).otherwise(0.0)


def year_in(text: Column) -> Column:
    """The year that a free date begins with, 0 if it doesn't begin with digits."""
    first = F.element_at(F.split(strip(text), r"\s+"), 1)
    return F.coalesce(F.when(first.rlike(r"^\d+$"), first).try_cast("int"), F.lit(0))


def guard_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity of two short strings: greedy matches within half the longer one, halved mismatches not rounded down,
    and up to four equal first letters at a tenth each, whatever the similarity. 1 if equal, empty ones too, 0 if one is empty.

    A fold over the letters of a; its cost is bounded by the names' lengths. Apply it to distinct pairs.
    """
    x, y = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    n, m = F.size(x), F.size(y)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
    start = F.array().cast("array<struct<i:int,j:int>>")

    def step(pairs: Column, i: Column) -> Column:
        free = F.filter(F.sequence(F.lit(1), m), lambda j: (j >= i - reach) & (j <= i + reach) & (F.get(y, j - 1) == F.get(x, i - 1)) & ~F.exists(pairs, lambda p: p["j"] == j))
        return F.when(F.size(free) > 0, F.concat(pairs, F.array(F.struct(i.alias("i"), F.get(free, F.lit(0)).alias("j"))))).otherwise(pairs)

    def finish(pairs: Column) -> Column:
        k = F.size(pairs).cast("double")
        left = F.transform(pairs, lambda p: F.get(x, p["i"] - 1))
        right = F.transform(F.array_sort(F.transform(pairs, lambda p: p["j"])), lambda j: F.get(y, j - 1))
        off = F.size(F.filter(F.zip_with(left, right, lambda u, v: u != v), lambda d: d)) / 2
        return F.when(k > 0, (k / n + k / m + (k - off) / k) / 3).otherwise(0.0)

    jaro = F.aggregate(F.sequence(F.lit(1), n), start, step, finish)
    same = [F.substring(a, 1, k) == F.substring(b, 1, k) for k in (4, 3, 2, 1)]
    prefix = F.lit(0)
    for k, c in zip((1, 2, 3, 4), reversed(same)):
        prefix = F.when(c & (F.length(a) >= k) & (F.length(b) >= k), F.lit(k)).otherwise(prefix)
    value = F.when((n == 0) | (m == 0), 0.0).otherwise(jaro + prefix * 0.1 * (1 - jaro))
    return F.when(a == b, 1.0).otherwise(value)
