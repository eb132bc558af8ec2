"""Budgets against transactions (rows B.. and J01). Every category of a row matches once: the pair primary/detailed is exploded and
joined on equality, with the cycle's days, the posting gate and the currency as residual conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.dates import cycle_end, cycle_start, day, monthly_budget
from ledgerlake.functions.filters import income_or_savings, not_deleted, posted_in
from ledgerlake.functions.money import ceil_to, cents_median, money, ratio, total, total_if


def by_category(tx: DataFrame) -> DataFrame:
    """A row for each distinct category of a transaction."""
    kinds = F.array_distinct(F.filter(F.array("category_primary", "category_detailed"), lambda c: c.isNotNull()))
    return tx.withColumn("category", F.explode(kinds))


def budget_rows(budgets: DataFrame, tx: DataFrame, start: Column, end: Column, deleted_too: bool = False, gate: bool = True, within: tuple[Column, Column] | None = None) -> DataFrame:
    """Budgets left-joined with their transactions from `start` to `end` (columns over the budget), both days included.

    within: constant days that no budget's range leaves; they reach the scan.
    """
    tx = tx.where(F.col("transaction_date").between(*within)) if within else tx
    rows = by_category(tx if deleted_too else tx.where(not_deleted())).select(F.col("user_id").alias("t_user"), F.col("category").alias("t_category"), "amount", "transaction_date", "pending", F.col("currency_code").alias("t_currency"))
    b = budgets.withColumns({"cycle_start": start, "cycle_end": end})
    same = (F.col("user_id") == F.col("t_user")) & (F.col("category") == F.col("t_category")) & F.col("transaction_date").between(F.col("cycle_start"), F.col("cycle_end"))
    if gate:
        same = same & posted_in(F.col("t_currency"))
    return b.join(rows, same, "left")


def _spent(budgets: DataFrame, tx: DataFrame, as_of: str, **how) -> DataFrame:
    """Each budget with its net spend in the cycle of as_of, cut at 0."""
    at = day(as_of)
    around = (F.date_add(at, -31), F.date_add(at, 31))  # no cycle is longer than a month
    joined = budget_rows(budgets, tx, cycle_start(F.col("period"), at), cycle_end(F.col("period"), at), within=around, **how)
    return joined.groupBy(*budgets.columns, "cycle_start", "cycle_end").agg(F.greatest(total(-F.col("amount")), F.lit(0)).cast("decimal(19,2)").alias("spent"))


def budget_summary(budgets: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """Spend, effective limit, what is left, burn rate, projection and daily allowance of the current cycle."""
    s = _spent(budgets, tx, as_of)
    days, gone = F.datediff("cycle_end", "cycle_start") + 1, F.datediff(day(as_of), "cycle_start") + 1
    limit = (F.col("monthly_limit") + F.when(F.col("rollover_enabled"), F.col("carried_amount")).otherwise(0)).cast("decimal(19,2)")
    s = s.withColumns({"effective_limit": limit, "days": days, "gone": gone})
    s = s.withColumn("remaining", (F.col("effective_limit") - F.col("spent")).cast("decimal(19,2)")).withColumn("burn_rate", money(F.col("spent") / F.col("gone")))
    left = F.col("days") - F.col("gone")
    allowance = F.when((F.col("remaining") > 0) & (left > 0), money(F.col("remaining") / left)).otherwise(F.lit(0).cast("decimal(19,2)"))
    return s.select("budget_id", "user_id", "category", "cycle_start", "cycle_end", "spent", "effective_limit", "remaining", "burn_rate", (F.col("burn_rate") * F.col("days")).cast("decimal(19,2)").alias("projected"), allowance.alias("daily_allowance"), ratio(F.col("spent"), F.col("effective_limit")).alias("used"))


def overrun_forecast(budgets: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """The larger of the pace and the median of the three months before, against the limit: HIGH from 1.10, MEDIUM from 0.95."""
    now = budget_summary(budgets, tx, as_of).select("budget_id", "projected", "effective_limit")
    first = F.trunc(day(as_of), "month")
    past = budget_rows(budgets, tx, F.add_months(first, -3), F.date_add(first, -1), gate=False, within=(F.add_months(first, -3), F.date_add(first, -1))).where("amount IS NOT NULL")
    months = past.groupBy("budget_id", F.trunc("transaction_date", "month").alias("month")).agg(F.greatest(total(-F.col("amount")), F.lit(0)).cast("decimal(19,2)").alias("net"))
    usual = months.groupBy("budget_id").agg(cents_median(F.col("net")).alias("usual"))
    out = now.join(usual, "budget_id", "left").withColumn("forecast", F.greatest("projected", F.coalesce("usual", F.lit(0))).cast("decimal(19,2)")).withColumn("share", ratio(F.col("forecast"), F.col("effective_limit")))
    return out.where("share >= 0.95").select("budget_id", "forecast", "share", F.when(F.col("share") >= 1.10, "HIGH").otherwise("MEDIUM").alias("severity"))


def exhaustion(budgets: DataFrame, tx: DataFrame, as_of: str, top: int = 5) -> DataFrame:
    """Budgets that run out within their cycle at the present pace; the first `top` of each user by days left."""
    s = budget_summary(budgets, tx, as_of).where(~income_or_savings(F.col("category")))
    left = F.datediff("cycle_end", day(as_of))
    days = F.when(F.col("remaining") <= 0, 0).when(F.col("burn_rate") > 0, F.floor(F.col("remaining") / F.col("burn_rate"))).cast("int")
    rows = s.withColumn("days_left", days).where(F.col("days_left").isNotNull() & ((F.col("remaining") <= 0) | (F.col("days_left") < left)))
    level = F.when(F.col("remaining") <= 0, "EXHAUSTED").when(F.col("days_left") <= 1, "CRITICAL").when(F.col("days_left") <= 3, "HIGH").otherwise("MEDIUM")
    order = Window.partitionBy("user_id").orderBy("days_left", "budget_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("user_id", "budget_id", "days_left", "remaining", level.alias("severity"), "place")


def rollover(budgets: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """What last month leaves over, carried on. Deleted rows count and refunds don't net, as in the source system."""
    first = F.trunc(day(as_of), "month")
    chosen = budgets.where(F.col("rollover_enabled") & ~income_or_savings(F.col("category")))
    rows = budget_rows(chosen, tx, F.add_months(first, -1), F.date_add(first, -1), deleted_too=True, within=(F.add_months(first, -1), F.date_add(first, -1)))
    return rows.groupBy("budget_id", "user_id", "monthly_limit", "carried_amount").agg(total_if(F.col("amount") < 0, F.abs("amount")).alias("spent")).withColumn("carry", (F.col("monthly_limit") + F.col("carried_amount") - F.col("spent")).cast("decimal(19,2)")).select("budget_id", "user_id", "spent", "carry")


THRESHOLDS = (50, 75, 90, 100)


def threshold_crossings(budgets: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """The highest threshold above the last alert; one step below it the bookmark falls back. The carried amount always counts."""
    s = _spent(budgets, tx, as_of, deleted_too=True)
    percent = (ratio(F.col("spent"), F.col("monthly_limit") + F.col("carried_amount")) * 100).cast("decimal(19,2)")
    reached = F.lit(0)
    for t in THRESHOLDS:
        reached = F.when(F.col("percent") >= t, t).otherwise(reached)
    below = F.when(F.col("last_alerted_threshold") == 100, 90).when(F.col("last_alerted_threshold") == 90, 75).when(F.col("last_alerted_threshold") == 75, 50).otherwise(0)
    s = s.withColumn("percent", percent).withColumn("reached", reached)
    mark = F.when(F.col("reached") > F.col("last_alerted_threshold"), F.col("reached")).when(F.col("percent") < below, F.col("reached")).otherwise(F.col("last_alerted_threshold"))
    return s.select("budget_id", "percent", "reached", (F.col("reached") > F.col("last_alerted_threshold")).alias("alert"), mark.alias("bookmark"))


def suggestions(tx: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Median of the months with rows, times 1.10, up to a multiple of 5; from two months on."""
    rows = tx.where(not_deleted() & (F.col("transaction_date") >= F.add_months(day(as_of), -months)) & (F.col("transaction_date") <= day(as_of)) & F.col("category_primary").isNotNull())
    net = rows.where(~income_or_savings(F.col("category_primary"))).groupBy("user_id", F.col("category_primary").alias("category"), F.trunc("transaction_date", "month").alias("month")).agg(F.greatest(total(-F.col("amount")), F.lit(0)).cast("decimal(19,2)").alias("net"))
    out = net.groupBy("user_id", "category").agg(cents_median(F.col("net")).alias("median"), F.count("*").alias("months_observed")).where("months_observed >= 2 AND median > 0")
    return out.withColumn("recommended", ceil_to(F.col("median") * F.lit("1.10").cast("decimal(5,2)"), 5))


def allocation_status(budgets: DataFrame, income: DataFrame) -> DataFrame:
    """Monthly equivalents of a user's budgets against the median income."""
    sums = budgets.where(~income_or_savings(F.col("category"))).groupBy("user_id").agg(total(monthly_budget(F.col("monthly_limit"), F.col("period"))).alias("allocated"))
    out = sums.join(income.select("user_id", "median_income"), "user_id", "left").withColumn("income", F.coalesce("median_income", F.lit(0)).cast("decimal(19,2)"))
    gap = F.col("income") - F.col("allocated")
    status = F.when(F.abs("gap") <= 1, "BALANCED").when(F.col("gap") > 0, "UNDER").otherwise("OVER")
    return out.withColumn("gap", gap).select("user_id", "allocated", "income", "gap", status.alias("status"))


def goal_flow(budgets: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """What a budget's underspend can still give to its goal."""
    at = day(as_of)
    linked = budgets.where(F.col("goal_id").isNotNull() & (F.col("goal_allocation") > 0))
    rows = budget_rows(linked, tx, cycle_start(F.col("period"), at), cycle_end(F.col("period"), at), within=(F.date_add(at, -31), F.date_add(at, 31)))
    s = rows.groupBy("budget_id", "goal_id", "monthly_limit", "goal_allocation", "last_goal_funded").agg(total_if(F.col("amount") < 0, F.abs("amount")).alias("spent"))
    room = F.least(F.greatest(F.col("monthly_limit") - F.col("spent"), F.lit(0)), F.col("goal_allocation"))
    return s.withColumn("fund", F.greatest(room - F.col("last_goal_funded"), F.lit(0)).cast("decimal(19,2)")).where("fund > 0").select("budget_id", "goal_id", "spent", "fund")


#: Factors of the seeding job.
SEED_FACTORS = {"DAILY": "30", "WEEKLY": "4.33", "BI_WEEKLY": "2.17", "MONTHLY": "1", "QUARTERLY": "1/3", "SEMI_ANNUAL": "1/6", "ANNUAL": "1/12"}


def seed_subscriptions_budget(subscriptions: DataFrame, budgets: DataFrame, cushion: float = 1.10) -> DataFrame:
    """A budget of all subscriptions' monthly cost with a cushion, in whole units, for users without one."""
    factor = F.lit(None).cast("double")
    for name, f in SEED_FACTORS.items():
        factor = F.when(F.col("frequency") == name, F.expr(f"CAST({f} AS DOUBLE)")).otherwise(factor)
    monthly = F.round((F.col("amount").cast("double") * factor).cast("decimal(19,6)"), 2)
    sums = subscriptions.where("active").groupBy("user_id").agg(total(monthly).alias("monthly"))
    has = budgets.where(F.lower("category") == "subscriptions").select("user_id").distinct()
    return sums.join(has, "user_id", "left_anti").select("user_id", "monthly", F.ceil(F.col("monthly") * F.lit(str(cushion)).cast("decimal(5,2)")).cast("decimal(19,2)").alias("budget_limit"))
