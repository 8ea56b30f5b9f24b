"""Exact sums of amounts that are stored as doubles.

An amount stands for the decimal that a cast of its double gives: the one that it was read from, up to fifteen digits. Nearly all amounts of money have at most four
decimals; those are counted in units of a ten-thousandth, as two long limbs that are summed apart: no order of rows
changes such a sum, and no limb overflows below 2^41 rows of a group. Other amounts are summed as decimals, whole part
and rest apart, so that neither leaves its type below 1e38. Only what no decimal holds is summed as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, LIMB, MOST_UNITS = 10_000, 22, 2**44
# The columns of a sum in parts, which can be summed again.
PARTS = ("units_high", "units_low", "odd_whole", "odd_rest", "odd_near", "beyond")
_WHOLE, _EXACT, _WIDE = "decimal(38,0)", "decimal(38,18)", "decimal(36,18)"


def _amounts(name: str) -> dict[str, Column]:
    """The parts of one amount; those that it does not have are null."""
    x = F.col(name).cast("double")
    scaled = F.rint(x * UNIT)
    plain = (F.abs(x) < MOST_UNITS / UNIT) & (scaled / UNIT == x)
    units = F.when(plain, scaled.cast("bigint"))
    # Null for all other amounts, so that the casts, which may be worked out for every row, cost nothing there.
    odd = F.when(~plain, x)
    exact, whole = odd.try_cast(_EXACT), odd.try_cast(_WHOLE)
    rest = exact % F.lit(1).cast("decimal(1,0)")
    return {
        "units_high": F.shiftright(units, LIMB),
        "units_low": units.bitwiseAND(F.lit(2**LIMB - 1)),
        # Amounts of 1e20 and more have no rest.
        "odd_whole": F.when(exact.isNotNull(), (exact - rest).cast(_WHOLE)).otherwise(whole),
        "odd_rest": rest,
        "odd_near": F.when(whole.isNotNull(), odd),
        "beyond": F.when(whole.isNull(), odd),
    }


def _sum(part: str, column: Column) -> Column:
    return F.try_sum(column) if part == "odd_whole" else F.sum(column)


def sum_parts(name: str) -> list[Column]:
    """Aggregates whose columns :func:`total_of_parts` sums further."""
    return [_sum(part, column).alias(part) for part, column in _amounts(name).items()]


def total_of_parts() -> Column:
    """The sum, as a double, over rows of ``sum_parts``; null without amounts."""
    # A whole part that has left its type stays lost.
    lost = F.count_if(F.col("odd_whole").isNull() & F.col("odd_near").isNotNull()) > 0
    sums = {part: _sum(part, F.col(part)) for part in PARTS}
    return _total({**sums, "odd_whole": F.when(~lost, sums["odd_whole"])})


def exact_sum(name: str) -> Column:
    """The sum of all amounts, as a double; null without amounts."""
    return _total({part: _sum(part, column) for part, column in _amounts(name).items()})


def _total(sums: dict[str, Column]) -> Column:
    high, low, whole, rest, near, beyond = (sums[part] for part in PARTS)
    units = high.cast("decimal(19,0)") * F.lit(2**LIMB).cast("decimal(7,0)") + low.cast("decimal(19,0)")
    plain = (units / F.lit(UNIT).cast("decimal(5,0)")).cast(_WIDE)
    zero = F.lit(0).cast("decimal(1,0)")
    # Types are narrow enough for a sum to keep all eighteen decimals.
    small = F.coalesce(plain, zero) + F.coalesce(rest.try_cast(_WIDE), zero)
    has_odd, has_any = near.isNotNull(), high.isNotNull() | near.isNotNull()
    # Beside whole parts of 1e18 and more the rest is below the last digit of a double.
    large = F.try_add(whole, small.cast(_WHOLE)).cast("double")
    odd = F.coalesce(F.try_add(small, whole.try_cast(_WIDE)).cast("double"), large, near + F.coalesce(plain.cast("double"), F.lit(0.0)))
    exact = F.when(has_odd, odd).when(has_any, plain.cast("double"))
    return F.when(beyond.isNull(), exact).otherwise(beyond + F.coalesce(exact, F.lit(0.0)))
