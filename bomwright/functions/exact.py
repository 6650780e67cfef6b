"""Sums of doubles that are exact until they are rounded once, so that the order of rows plays no part.

A double is cut into nine whole numbers of 26 bits, its multiples of 2 ** 49, 2 ** 23, ...,
2 ** -159, each cut exact. They are added up as whole numbers, by partial aggregation like
any sum; the totals' carries are settled and the leading digits rounded to the nearest
double, of two as near to the even one. Values between 2 ** -107 (about 6e-33) and 2 ** 75
(about 4e22), up to 2 ** 37 a group, are summed as ``math.fsum`` does (more of them stop a
query with an overflow, as sums of whole numbers do). Bits below 2 ** -159 are lost;
values beyond the upper end, infinities and NaN are added as doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

#: Bits of a part, the highest part's exponent, and how many there are.
BITS, HIGHEST, PARTS = 26, 49, 9
LIMIT = 2.0 ** (HIGHEST + BITS)
#: Digits above the highest part, into which totals carry.
SPARE = 2


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(x), use)[0]


def parts(x: Column) -> list[Column]:
    """The whole numbers of a double, highest first, and what has none."""
    x = x.cast("double")
    fits = F.abs(x) < LIMIT
    held = F.when(fits, x)
    out = []
    for k in range(PARTS):
        unit = 2.0 ** (HIGHEST - BITS * k)
        out.append(((held % (unit * 2**BITS) if k else held) * (1 / unit)).cast("bigint"))  # remainders of powers of two are exact
    return [*out, F.when(~fits, x)]


def _digits(low_first: Column) -> Column:
    """Digits of ``BITS`` bits, highest first, of a total that is not negative."""
    start = F.struct(F.lit(0).cast("bigint").alias("more"), F.array().cast("array<bigint>").alias("done"))
    add = lambda s, n: _bound(s["more"] + n, lambda t: F.struct(F.shiftright(t, BITS).alias("more"), F.concat(F.array(t.bitwiseAND(F.lit((1 << BITS) - 1))), s["done"]).alias("done")))
    return F.aggregate(low_first, start, add, lambda s: s["done"])


def _nearest(digits: Column) -> Column:
    """The double nearest to the digits: the first two and the next two are doubles without error, a last bit stands for all below, and one addition rounds."""

    def of(first: Column) -> Column:
        led = F.concat(F.slice(digits, first, 4), F.array_repeat(F.lit(0).cast("bigint"), 3))
        below = F.exists(F.slice(digits, first + 4, PARTS + SPARE), lambda n: n > 0).cast("bigint")
        high, low = (F.shiftleft(led[i], BITS) + led[i + 1] for i in (0, 2))
        return (high + (low * 2 + below) * 2.0 ** (-2 * BITS - 1)) * F.pow(F.lit(2.0), F.lit(HIGHEST + BITS * SPARE) - first * BITS)

    return _bound(F.array_position(F.transform(digits, lambda n: n > 0), True).cast("int"), lambda first: F.when(first > 0, of(first)).otherwise(0.0))


def _rounded_once(sums: list[Column]) -> Column:
    low_first = F.array(*reversed(sums), *[F.lit(0).cast("bigint")] * SPARE)
    sign = lambda a: F.when(F.aggregate(a, F.lit(0).cast("bigint"), lambda more, n: F.shiftright(more + n, BITS)) < 0, -1).otherwise(1)
    of_sign = lambda a: _bound(sign(a), lambda s: s * _bound(_digits(F.transform(a, lambda n: n * s)), _nearest))
    return _bound(low_first, of_sign)


def _usual(sums: list[Column], otherwise: Column) -> Column:
    """The same for the totals that are met most, without functions of higher order, which Spark interprets: below 2 ** 49, no bits below 2 ** -107, and not just below zero.

    Two parts make a number of 52 bits. Where the upper number is not tiny, the next is a
    double without error, with a last bit for what is below, and one addition rounds.
    """
    joined = lambda k: F.shiftleft(sums[k], BITS) + sums[k + 1]
    wide, mask = 2 * BITS, F.lit((1 << 2 * BITS) - 1)
    third = joined(5)
    second = joined(3) + F.shiftright(third, wide)
    first = joined(1) + F.shiftright(second, wide)
    second, third = second.bitwiseAND(mask), third.bitwiseAND(mask)
    below = F.when(third == 0, 0).otherwise(1)
    unit = lambda k: 2.0 ** (HIGHEST - BITS * k)
    small = (F.greatest(*(F.abs(n) for n in sums[1:7])) < F.lit(1 << 36)) & (sums[0] == 0) & (sums[7] == 0) & (sums[8] == 0)
    return (
        F.when(small & (F.abs(first) >= 4) & (F.abs(first) < F.lit(1 << 53)), first * unit(2) + (second * 2 + below) * (unit(4) / 2))
        .when(small & (first == 0), second * unit(4) + third * unit(6))
        .otherwise(otherwise)
    )


def exact_sum(x: Column, over: WindowSpec | None = None) -> Column:
    """The sum of a group or, with ``over``, of a window; null without any value. Windows of large tables: ``with_exact_sum``."""
    add = F.sum if over is None else lambda c: F.sum(c).over(over)
    return _total([add(part) for part in parts(x)])


def _total(added: list[Column]) -> Column:
    *sums, beyond = added
    total = _usual(sums, _rounded_once(sums))
    return F.when(sums[0].isNull(), beyond).when(beyond.isNull(), total).otherwise(total + beyond)


def with_exact_sum(rows: DataFrame, name: str, x: Column, over: WindowSpec) -> DataFrame:
    """Adds the exact sum of a window as a column.

    The whole numbers are added up in a step of their own: an expression that names a
    window function many times has it worked out as often, and the total names each
    about thirty times.
    """
    added = {f"{name}_part_{k}": F.sum(part).over(over) for k, part in enumerate(parts(x))}
    return rows.withColumns(added).withColumn(name, _total([F.col(c) for c in added])).drop(*added)
