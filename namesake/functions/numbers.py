"""Column functions over numbers."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a doubling, for which there is a table.
STEPS = 128


def _table() -> tuple[list[float], list[float]]:
    """Of each step the power of two and what rounding took off it, as a share."""
    with localcontext() as context:
        context.prec = 50
        exact = [Decimal(2) ** (Decimal(i) / STEPS) for i in range(STEPS)]
        return [float(x) for x in exact], [float(x / Decimal(float(x)) - 1) for x in exact]


def _doublings(x: Column) -> Column:
    """How often a step of a doubling is in x."""
    return F.rint(x * F.lit(float.fromhex("0x1.71547652b82fep0") * STEPS))


def _rest(x: Column, k: Column) -> Column:
    return (x + k * F.lit(float.fromhex("-0x1.62e42fefa0000p-8"))) + k * F.lit(float.fromhex("-0x1.cf79abc9e3b39p-47"))


def _power(x: Column, k: Column, r: Column) -> Column:
    powers, shares = (F.array(*[F.lit(v) for v in values]) for values in _table())
    step = F.pmod(k, F.lit(float(STEPS))).cast("int")
    c2, c3, c4, c5 = (F.lit(float.fromhex(c)) for c in ("0x1.ffffffffffdbdp-2", "0x1.555555555543cp-3", "0x1.55555cf172b91p-5", "0x1.1111167a4d017p-7"))
    more = (F.get(shares, step) + r) + (r * r) * (c2 + r * c3) + ((r * r) * (r * r)) * (c4 + r * c5)
    scale = F.get(powers, step) * F.pow(F.lit(2.0), F.floor(k / STEPS).cast("double"))
    return F.when(F.abs(x) < 700, scale + scale * more).otherwise(F.exp(x))


def exp(x: Column) -> Column:
    """e to the x with an error of .511 units of the last place, in the steps of the C library.

    Spark's own is Java's, which may be a unit off. That is seen where results are compared with 0: a score and its mirror image
    then cancel here and don't there. Beyond 700 either way it is Spark's own. x is in the expression many times over: for
    an x that is long, add_exp() has it as a column.
    """
    return _power(x, _doublings(x), _rest(x, _doublings(x)))


def add_exp(rows: DataFrame, name: str, x: Column) -> DataFrame:
    """The rows with exp(x), in steps whose columns are made once."""
    c = F.col
    rows = rows.withColumn("_x", x).withColumn("_k", _doublings(c("_x"))).withColumn("_r", _rest(c("_x"), c("_k")))
    return rows.withColumn(name, _power(c("_x"), c("_k"), c("_r"))).drop("_x", "_k", "_r")
