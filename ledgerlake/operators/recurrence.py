"""Regular income, bills and cash projections (rows D12, D13, X02, W01 to W11, F20, F21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.dates import day
from ledgerlake.functions.filters import between, is_transfer, not_deleted
from ledgerlake.functions.money import money, total, total_if
from ledgerlake.functions.text import merchant_or_description


def gaps(rows: DataFrame, *keys: str) -> DataFrame:
    """Days between a row and the one before it in its group."""
    order = Window.partitionBy(*keys).orderBy("transaction_date", "transaction_id")
    return rows.withColumn("gap", F.datediff("transaction_date", F.lag("transaction_date").over(order)))


def income_cadence(mean: Column) -> Column:
    return F.when(F.abs(mean - 7) <= 3, "WEEKLY").when(F.abs(mean - 14) <= 3, "BIWEEKLY").when(mean.between(13, 17), "SEMI_MONTHLY").when(mean.between(27, 33), "MONTHLY")


def frequency(median: Column) -> Column:
    """A subscription's frequency by its median gap."""
    bands = (("DAILY", 0.5, 2.5), ("WEEKLY", 6, 8), ("BI_WEEKLY", 13, 15), ("MONTHLY", 25, 35), ("QUARTERLY", 85, 95), ("SEMI_ANNUAL", 175, 185), ("ANNUAL", 360, 370))
    out = F.lit(None)
    for name, low, high in reversed(bands):
        out = F.when(median.between(low, high), name).otherwise(out)
    return out


def recurring_income(tx: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Positive rows, no transfers, by merchant and whole amount: three or more with a known cadence; confidence from tightness and count."""
    rows = tx.where((F.col("amount") > 0) & ~is_transfer() & between("transaction_date", F.add_months(day(as_of), -months), as_of))
    rows = rows.withColumn("merchant", F.lower(merchant_or_description())).withColumn("whole", F.round("amount", 0).cast("bigint"))
    g = gaps(rows, "user_id", "merchant", "whole").groupBy("user_id", "merchant", "whole").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sigma"), money(F.avg("amount")).alias("average"), F.max("transaction_date").alias("last"))
    g = g.where("n >= 3").withColumn("cadence", income_cadence(F.col("mean"))).where("cadence IS NOT NULL")
    tight = F.greatest(F.lit(0.0), 1 - F.col("sigma") / F.col("mean"))
    sure = F.round(0.7 * tight + 0.3 * F.least(F.lit(1.0), F.col("n") / 6.0), 4)
    return g.select("user_id", "merchant", "average", "n", "cadence", sure.alias("confidence"), F.date_add("last", F.round("mean", 0).cast("int")).alias("next_date"))


def bill_groups(tx: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    rows = tx.where(not_deleted() & (F.col("amount") < 0) & between("transaction_date", F.add_months(day(as_of), -months), as_of))
    rows = rows.withColumn("merchant", F.lower(merchant_or_description()))
    g = gaps(rows, "user_id", "merchant").groupBy("user_id", "merchant").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), money(F.avg(F.abs("amount"))).alias("amount"), F.max("transaction_date").alias("last"))
    return g.where((F.col("n") >= 2) & F.col("mean").between(25, 35))


def upcoming_bills(tx: DataFrame, as_of: str, horizon: int = 60) -> DataFrame:
    """Monthly bills rolled forward by their mean gap: a row for each due date from as_of up to the horizon."""
    step = F.round("mean", 0).cast("int")
    g = bill_groups(tx, as_of).withColumn("step", step)
    first = F.greatest(F.lit(1), F.ceil(F.datediff(day(as_of), "last") / F.col("step"))).cast("int")
    last = F.floor((F.datediff(day(as_of), "last") + horizon) / F.col("step")).cast("int")
    g = g.withColumn("first", first).withColumn("final", last).where("final >= first")
    return g.select("user_id", "merchant", "amount", F.explode(F.expr("transform(sequence(first, final), k -> date_add(last, k * step))")).alias("due"))


def cash_projection(tx: DataFrame, accounts: DataFrame, as_of: str, days: int = 31) -> DataFrame:
    """The running balance of each of the next days: liquid money, less the daily burn, plus expected income."""
    burn_rows = tx.where(not_deleted() & (F.col("amount") < 0) & ~is_transfer() & between("transaction_date", F.date_add(day(as_of), -30), as_of))
    burn = burn_rows.groupBy("user_id").agg(money(total(F.abs("amount")) / 30).alias("burn"))
    liquid = accounts.where(F.lower("account_type").isin("checking", "savings")).groupBy("user_id").agg(total(F.col("balance")).alias("liquid"))
    income = recurring_income(tx, as_of).groupBy("user_id", F.col("next_date").alias("date")).agg(total(F.col("average")).alias("income"))
    spine = liquid.select("user_id", "liquid", F.explode(F.sequence(F.date_add(day(as_of), 1), F.date_add(day(as_of), days))).alias("date"))
    rows = spine.join(burn, "user_id", "left").join(income, ["user_id", "date"], "left")
    so_far = Window.partitionBy("user_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    change = F.coalesce("income", F.lit(0)) - F.coalesce("burn", F.lit(0))
    return rows.withColumn("change", change.cast("decimal(19,2)")).select("user_id", "date", "change", (F.col("liquid") + F.sum("change").over(so_far)).cast("decimal(19,2)").alias("balance"))


def last_rows(tx: DataFrame, n: int = 3) -> DataFrame:
    """The last n charges of each merchant."""
    rows = tx.where(F.col("merchant_name").isNotNull() & (F.col("amount") < 0))
    order = Window.partitionBy("user_id", "merchant_name").orderBy(F.desc("transaction_date"), F.desc("transaction_id"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("user_id", "merchant_name", "transaction_id", "amount", "place")


def first_and_last(tx: DataFrame) -> DataFrame:
    at = F.struct("transaction_date", "transaction_id")
    return tx.where(F.col("merchant_name").isNotNull() & (F.col("amount") < 0)).groupBy("user_id", "merchant_name").agg(F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"), F.max_by("amount", at).alias("last_amount"), F.count("*").alias("n"))


def anchors(tx: DataFrame, share: float = 0.8) -> DataFrame:
    """Merchants whose charges keep to a weekday (so many of them), or to two days around a day of the month."""
    rows = tx.where(F.col("merchant_name").isNotNull() & (F.col("amount") < 0))
    by = ("user_id", "merchant_name")
    n = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n >= 3")
    top = lambda df, k: df.groupBy(*by).agg(F.max_by(k, F.struct("k", -F.col(k))).alias(k), F.max("k").alias(f"{k}_n"))
    weekday = top(rows.groupBy(*by, F.dayofweek("transaction_date").alias("weekday")).agg(F.count("*").alias("k")), "weekday")
    near = rows.select(*by, F.explode(F.sequence(F.greatest(F.lit(1), F.dayofmonth("transaction_date") - 2), F.least(F.lit(31), F.dayofmonth("transaction_date") + 2))).alias("monthday"))
    monthday = top(near.groupBy(*by, "monthday").agg(F.count("*").alias("k")), "monthday")
    out = n.join(weekday, list(by)).join(monthday, list(by))
    kind = F.when(F.col("weekday_n") >= share * F.col("n"), "WEEKDAY").when(F.col("monthday_n") >= share * F.col("n"), "MONTHDAY")
    return out.withColumn("anchor", kind).where("anchor IS NOT NULL").select(*by, "n", "anchor", F.when(F.col("anchor") == "WEEKDAY", F.col("weekday")).otherwise(F.col("monthday")).alias("day"))


def exponential_average(tx: DataFrame, alpha: float = 0.5) -> DataFrame:
    """EMA of the monthly positive goal rows, oldest first, started by the first value: a fold over the sorted months."""
    months = tx.where((F.col("amount") > 0) & F.col("goal_id").isNotNull()).groupBy("user_id", F.trunc("transaction_date", "month").alias("month")).agg(total(F.col("amount")).cast("double").alias("v"))
    listed = months.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "v"))), lambda s: s["v"]).alias("vs"))
    ema = F.aggregate(F.slice("vs", F.lit(2), F.greatest(F.size("vs") - 1, F.lit(0))), F.col("vs")[0], lambda a, x: alpha * x + (1 - alpha) * a)
    return listed.select("user_id", F.size("vs").alias("n_months"), F.round(ema, 4).alias("ema"))


def lifestyle_inflation(tx: DataFrame, as_of: str, least: float = 0.15) -> DataFrame:
    """Categories whose last 30 days exceed half of the 60 days before by more than `least`."""
    rows = tx.where(~F.coalesce("is_hidden", F.lit(False)) & (F.col("amount") < 0) & F.col("category_primary").isNotNull())
    recent = between("transaction_date", F.date_add(day(as_of), -30), as_of)
    prior = between("transaction_date", F.date_add(day(as_of), -90), F.date_add(day(as_of), -30))
    g = rows.where(recent | prior).groupBy("user_id", "category_primary").agg(total_if(recent, F.abs("amount")).alias("recent"), money(total_if(prior, F.abs("amount")) / 2).alias("prior"))
    return g.where("prior > 0").withColumn("growth", F.round((F.col("recent") - F.col("prior")).cast("decimal(19,2)") / F.col("prior"), 4)).where(F.col("growth") > least)
