"""Budget cycles, billing frequencies and date spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Biweekly cycles count from this day; 30.4375 days are a month.
EPOCH, MONTH_DAYS = "2024-01-01", 30.4375

#: Days without a payment after which a subscription counts as unused, by frequency.
UNUSED_DAYS = {"DAILY": 14, "WEEKLY": 21, "BI_WEEKLY": 35, "MONTHLY": 60, "QUARTERLY": 150, "SEMI_ANNUAL": 250, "ANNUAL": 90}


def day(d: str | Column) -> Column:
    return F.lit(d).cast("date") if isinstance(d, str) else d


def cycle_start(period: Column, d: Column) -> Column:
    """First day of the cycle that holds d: Monday weeks, 14 days from EPOCH (cut toward zero before it), else months."""
    from_epoch = F.datediff(d, day(EPOCH))
    biweekly = F.date_add(day(EPOCH), ((from_epoch / 14).cast("int") * 14).cast("int"))
    return F.when(F.lower(period) == "weekly", F.date_trunc("week", d).cast("date")).when(F.lower(period) == "biweekly", biweekly).otherwise(F.trunc(d, "month"))


def cycle_end(period: Column, d: Column) -> Column:
    """Last day of the cycle, inclusive."""
    start = cycle_start(period, d)
    return F.when(F.lower(period) == "weekly", F.date_add(start, 6)).when(F.lower(period) == "biweekly", F.date_add(start, 13)).otherwise(F.last_day(start))


def monthly_budget(limit: Column, period: Column) -> Column:
    """A cycle's limit as a month's, at two places."""
    days = F.when(F.lower(period) == "weekly", 7).when(F.lower(period) == "biweekly", 14)
    return F.when(days.isNotNull(), F.round(limit * F.lit("30.4375").cast("decimal(9,4)") / days, 2)).otherwise(limit).cast("decimal(19,2)")


def monthly_subscription(amount: Column, frequency: Column, factors: dict[str, str]) -> Column:
    """amount times the factor of its frequency; several operators have factors of their own."""
    out = F.lit(None)
    for name, factor in factors.items():
        out = F.when(frequency == name, F.expr(factor)).otherwise(out)
    return out


def next_payment(d: Column, frequency: Column) -> Column:
    """One billing step on; months are clamped to their end."""
    days = {"DAILY": 1, "WEEKLY": 7, "BI_WEEKLY": 14}
    months = {"MONTHLY": 1, "QUARTERLY": 3, "SEMI_ANNUAL": 6, "ANNUAL": 12}
    out = d
    for name, n in days.items():
        out = F.when(frequency == name, F.date_add(d, n)).otherwise(out)
    for name, n in months.items():
        out = F.when(frequency == name, F.add_months(d, n)).otherwise(out)
    return out


def roll_forward(d: Column, frequency: Column, as_of: Column, hops: int = 60) -> Column:
    """Billing steps from d until as_of or later, at most `hops` (step by step: month ends stay clamped)."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(hops)), d, lambda at, _: F.when(at < as_of, next_payment(at, frequency)).otherwise(at))


def month_spine(spark: SparkSession, as_of: str, n: int) -> DataFrame:
    """The first days of the last n months up to as_of's."""
    return spark.range(n).select(F.add_months(F.trunc(day(as_of), "month"), -F.col("id").cast("int")).alias("month"))


def week_spine(spark: SparkSession, as_of: str, n: int) -> DataFrame:
    """The Mondays of the last n weeks up to as_of's, with their place 0..n-1."""
    return spark.range(n).select(F.date_add(F.date_trunc("week", day(as_of)).cast("date"), (7 * (F.col("id") - (n - 1))).cast("int")).alias("week"), F.col("id").alias("x"))
