"""Grouped aggregates over all users at once (rows A.. of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.dates import cycle_end, cycle_start, day, week_spine
from ledgerlake.functions.filters import between, effective_category, income_or_savings, not_deleted
from ledgerlake.functions.money import cents_median, money, ratio, round_up_part, total, total_if
from ledgerlake.functions.text import merchant_key
from ledgerlake.operators.budgets import budget_rows


def spending_summary(tx: DataFrame, start: str, end: str) -> DataFrame:
    """Signed total and row count a user; deleted rows count, as in the source system."""
    return tx.where(between("transaction_date", start, end)).groupBy("user_id").agg(total(F.col("amount")).alias("total"), F.count("*").alias("n"))


def spending_by_category(tx: DataFrame, start: str, end: str) -> DataFrame:
    """Signed totals by primary, else detailed category; rows without either are left out."""
    rows = tx.where(between("transaction_date", start, end)).withColumn("category", effective_category())
    return rows.where("category IS NOT NULL").groupBy("user_id", "category").agg(total(F.col("amount")).alias("total"))


def income_expense_report(tx: DataFrame, start: str, end: str) -> DataFrame:
    """Income, expense and net a user; an amount of 0 is an expense."""
    rows = tx.where(not_deleted() & between("transaction_date", start, end))
    income, expense = total_if(F.col("amount") > 0, F.col("amount")), total_if(F.col("amount") <= 0, F.abs("amount"))
    return rows.groupBy("user_id").agg(income.alias("income"), expense.alias("expense")).withColumn("net", F.col("income") - F.col("expense"))


def expense_by_category(tx: DataFrame, start: str, end: str) -> DataFrame:
    rows = tx.where(not_deleted() & between("transaction_date", start, end) & (F.col("amount") <= 0))
    return rows.groupBy("user_id", effective_category("uncategorized").alias("category")).agg(total(F.abs("amount")).alias("spent"))


def _monthly(rows: DataFrame, value, as_of: str, months: int) -> DataFrame:
    """A value a user and month, with a 0 for each month without rows."""
    sums = rows.groupBy("user_id", F.trunc("transaction_date", "month").alias("month")).agg(total(value).alias("value"))
    users = rows.select("user_id").distinct()
    spine = users.select("user_id", F.explode(F.sequence(F.add_months(F.trunc(day(as_of), "month"), 1 - months), F.trunc(day(as_of), "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return spine.join(sums, ["user_id", "month"], "left").select("user_id", "month", F.coalesce("value", F.lit(0)).cast("decimal(19,2)").alias("value"))


def monthly_spend(tx: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    return _monthly(tx.where(not_deleted()), F.when(F.col("amount") < 0, F.abs("amount")), as_of, months)


def monthly_saving(tx: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    return _monthly(tx.where(not_deleted()), F.col("amount"), as_of, months)


def monthly_net_worth(snapshots: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """The last snapshot of each month, 0 where there is none."""
    last = snapshots.groupBy("user_id", F.trunc("snapshot_date", "month").alias("month")).agg(F.max_by("net_worth", "snapshot_date").alias("value"))
    users = snapshots.select("user_id").distinct()
    spine = users.select("user_id", F.explode(F.sequence(F.add_months(F.trunc(day(as_of), "month"), 1 - months), F.trunc(day(as_of), "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return spine.join(last, ["user_id", "month"], "left").select("user_id", "month", F.coalesce("value", F.lit(0)).cast("decimal(19,2)").alias("value"))


def net_worth(accounts: DataFrame) -> DataFrame:
    assets, debts = total_if(F.col("balance") >= 0, F.col("balance")), total_if(F.col("balance") < 0, F.abs("balance"))
    return accounts.groupBy("user_id").agg(assets.alias("assets"), debts.alias("liabilities")).withColumn("net_worth", F.col("assets") - F.col("liabilities"))


def merchant_weekly_trend(tx: DataFrame, as_of: str, weeks: int = 26) -> DataFrame:
    """Net spend a merchant and Monday week, cut at 0 and zero-filled: total, mean, active weeks, slope, label."""
    first = F.date_add(F.date_trunc("week", day(as_of)).cast("date"), -7 * (weeks - 1))
    rows = tx.where(not_deleted() & F.col("merchant_name").isNotNull() & (F.col("transaction_date") >= first) & (F.col("transaction_date") <= day(as_of)))
    rows = rows.withColumn("merchant", merchant_key(F.col("merchant_name"))).withColumn("week", F.date_trunc("week", "transaction_date").cast("date"))
    sums = rows.groupBy("user_id", "merchant", "week").agg(F.greatest(total(-F.col("amount")), F.lit(0)).cast("decimal(19,2)").alias("spent"))
    # Weeks without rows have spend 0, so they enter count and sums of x by closed form instead of a spine for each merchant.
    x = (F.datediff("week", first) / 7).cast("double")
    y = F.col("spent").cast("double")
    agg = sums.groupBy("user_id", "merchant").agg(total(F.col("spent")).alias("total"), F.count_if(F.col("spent") > 0).alias("weeks_with_spend"), F.sum(x * y).alias("xy"), F.sum(y).alias("sy"))
    n = float(weeks)
    sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    slope = (n * F.col("xy") - sx * F.col("sy")) / (n * sxx - sx * sx)
    average = F.round(F.col("total") / weeks, 2).cast("decimal(19,2)")
    share = F.abs("slope") / F.greatest(F.lit(0.01), F.col("average").cast("double"))
    label = F.when(share < 0.05, "FLAT").when(F.col("slope") > 0, "RISING").otherwise("FALLING")
    return agg.withColumn("average", average).withColumn("slope", F.round(slope, 4)).select("user_id", "merchant", "total", "average", "weeks_with_spend", "slope", label.alias("trend"))


def merchant_weeks(tx: DataFrame, as_of: str, weeks: int = 26) -> DataFrame:
    """The zero-filled weeks themselves, for each merchant with a row in them."""
    spine = week_spine(tx.sparkSession, as_of, weeks)
    first = F.date_add(F.date_trunc("week", day(as_of)).cast("date"), -7 * (weeks - 1))
    rows = tx.where(not_deleted() & F.col("merchant_name").isNotNull() & between("transaction_date", first, as_of))
    rows = rows.withColumn("merchant", merchant_key(F.col("merchant_name"))).withColumn("week", F.date_trunc("week", "transaction_date").cast("date"))
    sums = rows.groupBy("user_id", "merchant", "week").agg(F.greatest(total(-F.col("amount")), F.lit(0)).alias("spent"))
    every = sums.select("user_id", "merchant").distinct().select("user_id", "merchant", F.explode(F.sequence(first, F.date_trunc("week", day(as_of)).cast("date"), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return every.join(sums, ["user_id", "merchant", "week"], "left").join(F.broadcast(spine), "week").select("user_id", "merchant", "week", "x", F.coalesce("spent", F.lit(0)).cast("decimal(19,2)").alias("spent"))


def benchmark_percentiles(tx: DataFrame, preferences: DataFrame, as_of: str, least_users: int = 50, least_category: int = 15) -> DataFrame:
    """Opted-in users' monthly spend by bucket and category: interpolated quartiles, with small groups left out."""
    size = F.col("household_size")
    bucket = F.concat_ws("|", F.coalesce("income_tier", F.lit("inc-75-150k")), F.when(size <= 2, "1-2").when(size <= 4, "3-4").otherwise("5-plus"))
    users = preferences.where("anonymised_stats_opt_in").select("user_id", bucket.alias("bucket"))
    recent = tx.where(not_deleted() & (F.col("amount") < 0) & between("transaction_date", F.date_add(day(as_of), -90), as_of)).withColumn("category", effective_category()).where("category IS NOT NULL")
    spend = recent.groupBy("user_id", "category").agg((total(F.abs("amount")) / 3).alias("monthly"))
    rows = spend.join(users, "user_id")
    people = rows.groupBy("bucket").agg(F.count_distinct("user_id").alias("n_users")).where(F.col("n_users") >= least_users)
    # Over whole cents, so that interpolated quarters are exact and half cents round up.
    quartiles = F.percentile((F.round("monthly", 2) * 100).cast("bigint"), F.lit([0.25, 0.5, 0.75]))
    out = rows.groupBy("bucket", "category").agg(quartiles.alias("q"), F.count("*").alias("sample_size")).where(F.col("sample_size") >= least_category)
    return out.join(people.select("bucket"), "bucket", "left_semi").select("bucket", "category", *[(F.round(F.col("q")[k], 0) / 100).alias(n) for k, n in enumerate(("p25", "median", "p75"))], "sample_size")


def distinct_accounts_a_day(tx: DataFrame, as_of: str, days: int = 14, least: int = 2) -> DataFrame:
    """(merchant, day) charged on several accounts."""
    return _merchant_days(tx, as_of, days).agg(F.count_distinct("account_id").alias("n_accounts"), F.count("*").alias("n"), total(F.abs("amount")).alias("total")).where(F.col("n_accounts") >= least)


def bursts(tx: DataFrame, as_of: str, days: int = 14, least: int = 4) -> DataFrame:
    return _merchant_days(tx, as_of, days).agg(F.count("*").alias("n"), total(F.abs("amount")).alias("total")).where(F.col("n") >= least)


def cross_account_rows(tx: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    recent = tx.where(not_deleted() & (F.col("amount") < 0) & F.col("account_id").isNotNull() & between("transaction_date", F.date_add(day(as_of), -days), as_of))
    return recent.where("merchant_name IS NOT NULL").withColumn("merchant", F.lower(F.trim("merchant_name")))


def _merchant_days(tx: DataFrame, as_of: str, days: int):
    return cross_account_rows(tx, as_of, days).groupBy("user_id", "merchant", "transaction_date")


def median_monthly_income_expense(tx: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Medians of the monthly sums of the months that have rows (no zero fill)."""
    rows = tx.where(not_deleted() & (F.col("transaction_date") >= F.add_months(day(as_of), -months)) & (F.col("transaction_date") <= day(as_of)))
    income = (F.col("amount") > 0) & (income_or_savings(F.col("category_primary")) | income_or_savings(F.col("category_detailed")))
    sums = rows.groupBy("user_id", F.trunc("transaction_date", "month").alias("month")).agg(F.sum(F.when(income, F.col("amount"))).cast("decimal(19,2)").alias("income"), F.sum(F.when(F.col("amount") < 0, -F.col("amount"))).cast("decimal(19,2)").alias("expense"))
    return sums.groupBy("user_id").agg(F.coalesce(cents_median(F.col("income")), F.lit(0)).alias("median_income"), F.coalesce(cents_median(F.col("expense")), F.lit(0)).alias("median_expense"))


def display_names(tx: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The most frequent spelling of each merchant key; names of active subscriptions weigh 5; ties by name."""
    named = tx.where("merchant_name IS NOT NULL").select("user_id", F.col("merchant_name").alias("name"), F.lit(1).alias("w"))
    named = named.unionByName(subscriptions.where("active").select("user_id", F.col("merchant_name").alias("name"), F.lit(5).alias("w")))
    sums = named.groupBy("user_id", merchant_key(F.col("name")).alias("merchant"), "name").agg(F.sum("w").alias("weight"))
    best = Window.partitionBy("user_id", "merchant").orderBy(F.desc("weight"), "name")
    return sums.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def import_statistics(imports: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("COMPLETED", "FAILED", "PARTIAL")]
    return imports.groupBy("user_id").agg(F.count("*").alias("n_imports"), *counts, *[F.sum(c).alias(f"{c}_rows") for c in ("successful", "failed", "duplicates")])


def contribution_insights(tx: DataFrame) -> DataFrame:
    """Positive goal rows: total, mean, largest, count, and the source that brings most."""
    source = F.when(F.col("round_up_source_transaction_id").isNotNull(), "ROUND_UP").when(income_or_savings(F.col("category_primary")), "INCOME").when(F.lower("description").contains("transfer"), "RECURRING_TRANSFER").otherwise("MANUAL")
    rows = tx.where((F.col("amount") > 0) & F.col("goal_id").isNotNull()).withColumn("source", source)
    by_source = rows.groupBy("user_id", "goal_id", "source").agg(total(F.col("amount")).alias("part"), F.count("*").alias("k"), F.max("amount").alias("top"))
    first = F.max_by("source", F.struct("part", "source"))
    return by_source.groupBy("user_id", "goal_id").agg(total(F.col("part")).alias("total"), F.sum("k").alias("n"), F.max("top").alias("largest"), first.alias("top_source")).withColumn("average", money(F.col("total") / F.col("n")))


def linked_balances(goals: DataFrame, accounts: DataFrame) -> DataFrame:
    """user_id, goal_id, balance: the sum of the positive balances of a goal's linked accounts (an array, each account once)."""
    each = goals.select("user_id", "goal_id", F.explode(F.array_distinct("linked_account_ids")).alias("account_id"))
    return each.join(accounts.where("balance > 0").select("account_id", "balance"), "account_id").groupBy("user_id", "goal_id").agg(total(F.col("balance")).alias("balance"))


def goal_progress(goals: DataFrame, tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Positive goal rows plus the positive balances of the linked account (linked_account_id), or accounts (linked_account_ids, an array), at
    most the target; and the percent, at most 100."""
    paid = tx.where((F.col("amount") > 0) & F.col("goal_id").isNotNull()).groupBy("user_id", "goal_id").agg(total(F.col("amount")).alias("paid"))
    joined = goals.join(paid, ["user_id", "goal_id"], "left")
    if "linked_account_ids" in goals.columns:
        joined = joined.join(linked_balances(goals, accounts), ["user_id", "goal_id"], "left")
    else:
        joined = joined.join(accounts.where("balance > 0").select(F.col("account_id").alias("linked_account_id"), "balance"), "linked_account_id", "left")
    sums = F.coalesce("paid", F.lit(0)) + F.coalesce("balance", F.lit(0))
    current = F.least(sums, F.col("target_amount")).cast("decimal(19,2)")
    percent = F.least(F.round(ratio(F.col("progress"), F.col("target_amount")) * 100, 0), F.lit(100)).cast("int")
    return joined.withColumn("progress", current).select("user_id", "goal_id", "target_amount", "progress", percent.alias("percent"))


def round_up_total(tx: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = tx.where(not_deleted() & F.col("round_up_source_transaction_id").isNotNull() & between("transaction_date", F.date_add(day(as_of), -days), as_of))
    return rows.groupBy("user_id").agg(total(F.abs("amount")).alias("total"), F.count("*").alias("n"))


def round_up_contributions(tx: DataFrame, goals: DataFrame) -> DataFrame:
    """One derived row for each expense whose goal rounds up."""
    enabled = goals.where("round_up_enabled AND NOT completed").select("user_id", "goal_id")
    rows = tx.where((F.col("amount") < 0) & F.col("round_up_source_transaction_id").isNull()).join(enabled, ["user_id", "goal_id"])
    return rows.withColumn("round_up", round_up_part(F.col("amount"))).where("round_up > 0").select("user_id", "goal_id", F.col("transaction_id").alias("source_transaction_id"), "round_up", F.md5(F.concat_ws("|", F.lit("roundup"), "transaction_id")).alias("round_up_id"))


def category_density(subscriptions: DataFrame) -> DataFrame:
    """Active subscriptions by category: count and monthly equivalent (30, 4.333 and 2.167 a month)."""
    factor = {"DAILY": "30.0", "WEEKLY": "4.333", "BI_WEEKLY": "2.167", "MONTHLY": "1.0", "QUARTERLY": "1.0 / 3", "SEMI_ANNUAL": "1.0 / 6", "ANNUAL": "1.0 / 12"}
    f = F.lit(None).cast("double")
    for name, x in factor.items():
        f = F.when(F.col("frequency") == name, F.expr(f"CAST({x} AS DOUBLE)")).otherwise(f)
    monthly = F.round((F.col("amount").cast("double") * f).cast("decimal(19,6)"), 2)
    return subscriptions.where("active").groupBy("user_id", "category").agg(F.count("*").alias("n"), total(monthly).alias("monthly"))


def weekly_digest(tx: DataFrame, budgets: DataFrame, goals: DataFrame, as_of: str) -> DataFrame:
    """What a user spent and got in the last week, how many budgets are above the part of their limit that the elapsed days of the cycle
    allow (four places), and how many open goals are more than a quarter full."""
    at = day(as_of)
    week = tx.where(not_deleted() & between("transaction_date", F.date_add(at, -7), as_of))
    flows = week.groupBy("user_id").agg(total_if(F.col("amount") < 0, F.abs("amount")).alias("spent"), total_if(F.col("amount") > 0, F.col("amount")).alias("income"))
    start, end = cycle_start(F.col("period"), at), cycle_end(F.col("period"), at)
    rows = budget_rows(budgets, tx, start, F.least(end, at), within=(F.date_add(at, -31), at)).withColumn("days", F.datediff(end, "cycle_start") + 1)
    cents = lambda c: (F.col(c) * 100).cast("bigint")
    spend = rows.groupBy("budget_id", "user_id", "cycle_start", "days", cents("monthly_limit").alias("limit_cents")).agg(F.coalesce(F.sum(F.when(F.col("amount") < 0, -cents("amount"))), F.lit(0)).alias("spend_cents"))
    spend = spend.withColumn("gone", F.greatest(F.lit(1), F.least(F.col("days"), F.datediff(at, "cycle_start") + 1))).withColumn("share", F.expr("(20000 * gone + days) div (2 * days)"))
    over = spend.groupBy("user_id").agg(F.count_if(F.col("spend_cents") * 10000 > F.col("limit_cents") * F.col("share")).alias("over_budget"))
    on_track = goals.where(~F.coalesce("completed", F.lit(False)) & (4 * F.col("current_amount") > F.col("target_amount"))).groupBy("user_id").agg(F.count("*").alias("goals_on_track"))
    zero = F.lit(0).cast("decimal(19,2)")
    j = flows.join(over, "user_id", "full").join(on_track, "user_id", "full")
    return j.select("user_id", F.coalesce("spent", zero).alias("spent"), F.coalesce("income", zero).alias("income"), F.coalesce("over_budget", F.lit(0)).alias("over_budget"), F.coalesce("goals_on_track", F.lit(0)).alias("goals_on_track"))


def financial_health(tx: DataFrame, accounts: DataFrame, as_of: str) -> DataFrame:
    """Three-month means, savings rate, debt to income, and how far liquid money covers six months of expense."""
    rows = tx.where(between("transaction_date", F.add_months(day(as_of), -3), as_of))
    visible = ~F.coalesce("is_hidden", F.lit(False))
    flows = rows.groupBy("user_id").agg(money(total_if(F.col("amount") > 0, F.col("amount")) / 3).alias("income"), money(total_if((F.col("amount") < 0) & visible, F.abs("amount")) / 3).alias("expense"))
    kinds = F.lower("account_type")
    sides = accounts.groupBy("user_id").agg(total_if(kinds.isin("checking", "savings") & (F.col("balance") > 0), F.col("balance")).alias("liquid"), total_if(F.col("balance") < 0, F.abs("balance")).alias("debt"))
    out = flows.join(sides, "user_id", "left")
    out = out.withColumn("savings_rate", ratio(F.col("income") - F.col("expense"), F.col("income")))
    return out.select("user_id", "income", "expense", "savings_rate", ratio(F.coalesce("debt", F.lit(0)), F.col("income") * 12).alias("debt_to_income"), F.least(ratio(F.coalesce("liquid", F.lit(0)), F.col("expense") * 6), F.lit(1)).cast("decimal(19,4)").alias("emergency_progress"))
