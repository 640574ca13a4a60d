"""Dimension algebra: sorted arrays of (base, num, den) exponents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _gcd(a: Column, b: Column) -> Column:
    """Euclid in a fixed number of steps, enough for 32-bit values."""
    step = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(F.abs(a).alias("a"), F.abs(b).alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("bigint"))).alias("b"))))
    return step["a"]


def combined(left: Column, right: Column, sign: int | Column) -> Column:
    """The dimension of a product (sign 1) or quotient (sign -1, also by row); zero exponents vanish."""
    bases = F.array_sort(F.array_union(F.transform(left, lambda e: e["base"]), F.transform(right, lambda e: e["base"])))

    def exponent(side: Column, base: Column) -> Column:
        return F.try_element_at(F.filter(side, lambda e: e["base"] == base), F.lit(1))

    def total(base: Column) -> Column:
        a, b = exponent(left, base), exponent(right, base)
        an, ad = F.coalesce(a["num"], F.lit(0)).cast("bigint"), F.coalesce(a["den"], F.lit(1)).cast("bigint")
        bn, bd = F.coalesce(b["num"], F.lit(0)).cast("bigint"), F.coalesce(b["den"], F.lit(1)).cast("bigint")
        num, den = an * bd + bn * ad * sign, ad * bd
        g = F.greatest(_gcd(num, den), F.lit(1).cast("bigint"))
        return F.struct(base.alias("base"), (num / g).cast("bigint").alias("num"), (den / g).cast("bigint").alias("den"))

    return F.filter(F.transform(bases, total), lambda e: e["num"] != 0)


def scaled(c: Column, num: Column, den: Column) -> Column:
    """The dimension of a power with the exponent num / den; null if den is zero or unknown."""
    n, d = num.cast("bigint"), den.cast("bigint")
    sign = F.when(d < 0, -1).otherwise(1).cast("bigint")

    def one(e: Column) -> Column:
        a, b = e["num"] * n * sign, e["den"] * F.abs(d)
        g = F.greatest(_gcd(a, b), F.lit(1).cast("bigint"))
        return F.struct(e["base"].alias("base"), (a / g).cast("bigint").alias("num"), (b / g).cast("bigint").alias("den"))

    return F.when(F.coalesce(d, F.lit(0)) != 0, F.filter(F.transform(c, one), lambda e: e["num"] != 0))


def dimension_text(c: Column) -> Column:
    """A dimension as text, such as ``length:1/1 time:-2/1``."""
    return F.array_join(F.transform(c, lambda e: F.concat(e["base"], F.lit(":"), e["num"].cast("string"), F.lit("/"), e["den"].cast("string"))), " ")
