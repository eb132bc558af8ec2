"""Money and ratios: exact decimals, rounded half up (Spark's round), and the guards against zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, RATIO = "decimal(19,2)", "decimal(19,4)"


def money(c: Column) -> Column:
    """HALF_UP at two places."""
    return F.round(c, 2).cast(MONEY)


def ratio(a: Column, b: Column) -> Column:
    """a / b at four places; 0 where b is 0 or null. Operands stay narrow, so no digits are lost before rounding."""
    safe = F.when(b == 0, F.lit(None)).otherwise(b).cast(MONEY)
    return F.coalesce(F.round(a.cast(MONEY) / safe, 4).cast(RATIO), F.lit(0).cast(RATIO))


def total(c: Column) -> Column:
    """Sum as money; 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def total_if(condition: Column, c: Column) -> Column:
    return total(F.when(condition, c))


def cents_median(c: Column) -> Column:
    """The median of money, by cents, so that the mean of two middle values is exact; rounded half up."""
    return F.round(F.median((c * 100).cast("bigint")).cast("decimal(24,2)") / 100, 2).cast(MONEY)


def round_to(c: Column, step: int) -> Column:
    """Half up to a multiple of `step`."""
    return (F.round(c / step, 0) * step).cast(MONEY)


def ceil_to(c: Column, step: int) -> Column:
    return (F.ceil(c / step) * step).cast(MONEY)


def round_up_part(c: Column) -> Column:
    """What is missing from |c| to the next whole unit."""
    return (F.ceil(F.abs(c)) - F.abs(c)).cast(MONEY)


def nearest_rank(c: str, share: float) -> Column:
    """An aggregate: the value at place ceil(share * n) in ascending order."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {c})")
