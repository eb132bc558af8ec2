"""Forecasts, goals and plans (rows X01, X03 to X08, X11, G01, G02, G04, W07, W12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.dates import MONTH_DAYS, day
from ledgerlake.functions.filters import between
from ledgerlake.functions.money import money, ratio, total, total_if
from ledgerlake.operators.aggregates import financial_health, median_monthly_income_expense
from ledgerlake.operators.recurrence import gaps


def cash_flow(tx: DataFrame, accounts: DataFrame, as_of: str) -> DataFrame:
    """Runway in days of liquid money at the usual burn (365 at most), cash in 30, 60 and 90 days, and a status."""
    usual = median_monthly_income_expense(tx, as_of).withColumn("net", (F.col("median_income") - F.col("median_expense")).cast("decimal(19,2)"))
    liquid = accounts.where("active").where(F.lower("account_type").isin("checking", "savings")).groupBy("user_id").agg(total(F.col("balance")).alias("liquid"))
    j = usual.join(liquid, "user_id", "left").withColumn("liquid", F.coalesce("liquid", F.lit(0)).cast("decimal(19,2)"))
    burn = -F.col("net")
    days = F.when(F.col("net") >= 0, F.lit(365)).otherwise(F.greatest(F.lit(0), F.least(F.lit(365), F.floor(F.col("liquid").cast("double") / burn.cast("double") * MONTH_DAYS)))).cast("int")
    status = F.when(F.col("net") >= 0, "SURPLUS").when(F.col("runway") < 30, "CRITICAL").when(F.col("runway") < 60, "LOW").when(F.col("runway") < 90, "TIGHT").otherwise("HEALTHY")
    cash = [(F.col("liquid") + k * F.col("net")).cast("decimal(19,2)").alias(f"cash_{30 * k}") for k in (1, 2, 3)]
    return j.withColumn("runway", days).select("user_id", "liquid", "net", "runway", *cash, status.alias("status"))


def regression(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Slope and fit of a value over its place in date order, with mean, count and the value expected next (not below 0)."""
    order = Window.partitionBy(*keys).orderBy("transaction_date", "transaction_id")
    r = rows.withColumn("x", (F.row_number().over(order) - 1).cast("double")).withColumn("y", value.cast("double"))
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.percentile("y", F.lit([0.25, 0.75])).alias("q"), F.max("y").alias("top"))
    following = F.greatest(F.lit(0.0), F.col("slope") * F.col("n") + F.col("mean") - F.col("slope") * (F.col("n") - 1) / 2)
    return g.withColumn("following", following)


def _spending(tx: DataFrame, as_of: str, months: int) -> DataFrame:
    return tx.where((F.col("amount") < 0) & F.col("category_primary").isNotNull() & between("transaction_date", F.add_months(day(as_of), -months), as_of))


def predicted_anomalies(tx: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Categories that rise steadily to over twice their mean, or whose largest row lies beyond the upper fence."""
    g = regression(_spending(tx, as_of, months), ["user_id", "category_primary"], F.abs("amount")).where("n >= 4")
    trend = (F.col("slope") > 0) & (F.col("r2") > 0.5) & (F.col("following") > 2 * F.col("mean"))
    fence = F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])
    return g.withColumn("kind", F.when(trend, "TREND").when(F.col("top") > fence, "FENCE")).where("kind IS NOT NULL").select("user_id", "category_primary", "n", "kind", F.round("following", 2).alias("following"), F.round(fence, 2).alias("fence"))


def predicted_cuts(tx: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Merchants that are used less and less, and categories that are expected over 1.2 times their mean."""
    rows = _spending(tx, as_of, months)
    falling = regression(rows.where("merchant_name IS NOT NULL"), ["user_id", "merchant_name"], F.abs("amount")).where("n >= 3 AND slope < -0.1").select("user_id", F.col("merchant_name").alias("name"), F.lit("USAGE").alias("kind"), F.round("slope", 4).alias("value"))
    rising = regression(rows, ["user_id", "category_primary"], F.abs("amount")).where("n >= 3 AND following > 1.2 * mean").select("user_id", F.col("category_primary").alias("name"), F.lit("CATEGORY").alias("kind"), F.round("following", 4).alias("value"))
    return falling.unionByName(rising)


def goal_probability(tx: DataFrame, goals: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """min(0.95, savings rate x consistency x 10), halved under a rate of 0.1; consistency is 1 - the variation of the monthly rates."""
    rows = tx.where(between("transaction_date", F.add_months(day(as_of), -months), as_of))
    m = rows.groupBy("user_id", F.trunc("transaction_date", "month").alias("month")).agg(total_if(F.col("amount") > 0, F.col("amount")).alias("income"), total_if(F.col("amount") < 0, F.abs("amount")).alias("expense"))
    m = m.where("income > 0").withColumn("rate", ((F.col("income") - F.col("expense")).cast("double") / F.col("income").cast("double")))
    g = m.groupBy("user_id").agg(F.avg("rate").alias("rate"), F.stddev_pop("rate").alias("sigma"))
    steady = F.when(F.col("rate") > 0, F.greatest(F.lit(0.0), 1 - F.col("sigma") / F.col("rate"))).otherwise(0.0)
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.col("rate")) * F.col("steady") * 10)
    g = g.withColumn("steady", steady).withColumn("p", F.round(F.when(F.col("rate") < 0.1, p / 2).otherwise(p), 4))
    return goals.where("NOT completed").join(g, "user_id").select("goal_id", "user_id", F.round("rate", 4).alias("rate"), F.round("steady", 4).alias("consistency"), F.col("p").alias("probability"))


def payment_risk(tx: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Merchants with uneven gaps (consistency under 0.7) whose next payment is expected within a week."""
    rows = tx.where((F.col("amount") < 0) & F.col("merchant_name").isNotNull() & between("transaction_date", F.add_months(day(as_of), -months), as_of))
    g = gaps(rows, "user_id", "merchant_name").groupBy("user_id", "merchant_name").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sigma"), F.max("transaction_date").alias("last")).where("n >= 3 AND mean > 0")
    g = g.withColumn("consistency", F.round(F.greatest(F.lit(0.0), 1 - F.col("sigma") / F.col("mean")), 4)).withColumn("expected", F.date_add("last", F.floor("mean").cast("int")))
    return g.where((F.col("consistency") < 0.7) & (F.datediff("expected", day(as_of)) < 7)).select("user_id", "merchant_name", "n", "consistency", "expected")


def interest_forecast(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """A card's balance moved on by the trend of its last 12 rows, and a year's interest on it."""
    order = Window.partitionBy("account_id").orderBy(F.desc("transaction_date"), F.desc("transaction_id"))
    last = tx.withColumn("r", F.row_number().over(order)).where("r <= 12")
    trend = regression(last, ["account_id"], F.col("amount")).select("account_id", "n", F.coalesce("slope", F.lit(0.0)).alias("slope"))
    cards = accounts.where("account_type = 'creditCard' AND apr_percent IS NOT NULL").join(trend, "account_id")
    expected = F.greatest(F.lit(0.0), F.abs("balance").cast("double") - F.col("slope"))
    return cards.select("account_id", "user_id", "n", F.round(expected, 4).alias("expected_balance"), F.round(expected * F.col("apr_percent").cast("double") / 100, 6).alias("annual_interest"))


def discretionary(tx: DataFrame, as_of: str, least: int = 200) -> DataFrame:
    """Discretionary categories over 200 a month, of which a fifth could go; and merchants that are dear (mean over 50) and rare (twice at most)."""
    rows = tx.where(~F.coalesce("is_hidden", F.lit(False)) & (F.col("amount") < 0) & between("transaction_date", F.date_add(day(as_of), -90), as_of))
    by_category = rows.where(F.lower("category_primary").isin("entertainment", "dining", "shopping", "travel", "hobbies")).groupBy("user_id", F.col("category_primary").alias("name")).agg(money(total(F.abs("amount")) / 3).alias("monthly")).where(F.col("monthly") > least)
    cuts = by_category.select("user_id", F.lit("DISCRETIONARY").alias("kind"), "name", money(F.col("monthly") * F.lit("0.20").cast("decimal(3,2)")).alias("saving"))
    rare = rows.where("merchant_name IS NOT NULL").groupBy("user_id", F.col("merchant_name").alias("name")).agg(F.count("*").alias("n"), money(F.avg(F.abs("amount"))).alias("mean")).where("n <= 2 AND mean > 50")
    return cuts.unionByName(rare.select("user_id", F.lit("RARE").alias("kind"), "name", F.col("mean").alias("saving")))


def goal_projection(goals: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """Mean monthly contribution of three months, months still needed, and whether that is in time."""
    paid = tx.where((F.col("amount") > 0) & F.col("goal_id").isNotNull() & between("transaction_date", F.add_months(day(as_of), -3), as_of)).groupBy("user_id", "goal_id").agg(total(F.col("amount")).alias("paid"))
    j = goals.join(paid, ["user_id", "goal_id"], "left").withColumn("monthly", money(F.coalesce("paid", F.lit(0)) / 3)).withColumn("missing", F.greatest(F.lit(0), F.col("target_amount") - F.col("current_amount")).cast("decimal(19,2)"))
    need = F.when(F.col("monthly") > 0, F.ceil(F.col("missing") / F.col("monthly"))).cast("int")
    j = j.withColumn("months_needed", need).withColumn("months_left", F.floor(F.months_between("target_date", day(as_of))).cast("int"))
    status = F.when(F.col("completed") | (F.col("missing") == 0), "COMPLETED").when(F.col("monthly") == 0, "NO_CONTRIBUTIONS").when(F.col("months_needed") > F.col("months_left"), "BEHIND").when(F.col("months_needed") < F.col("months_left") - 1, "AHEAD").otherwise("ON_TRACK")
    return j.select("goal_id", "user_id", "monthly", "missing", "months_needed", "months_left", status.alias("status"))


def projection_bands(goals: DataFrame, tx: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    """Months to a goal at the exponentially weighted monthly rate (p50) and at a deviation less (p90), for goals with contributions in two
    months or more; and whether that rate is above or below the mean over the months since the first contribution (30 days each)."""
    at = day(as_of)
    rows = tx.where((F.col("amount") > 0) & F.col("goal_id").isNotNull() & (F.col("transaction_date") > F.add_months(at, -months)) & (F.col("transaction_date") <= at))
    by_month = rows.groupBy("user_id", "goal_id", F.trunc("transaction_date", "month").alias("month")).agg(F.sum("amount").alias("paid"), F.min("transaction_date").alias("first"))
    sums = F.transform(F.array_sort(F.collect_list(F.struct("month", "paid"))), lambda m: m["paid"].cast("double"))
    g = by_month.groupBy("user_id", "goal_id").agg(sums.alias("v"), F.sum("paid").alias("total"), F.min("first").alias("first")).where(F.size("v") >= 2)
    span = F.greatest(F.lit(1), F.least(F.lit(months), F.floor((F.datediff(at, "first") + 1 + 29) / 30)))
    ema = F.aggregate(F.slice("v", F.lit(2), F.size("v") - 1), F.col("v")[0], lambda e, x: 0.5 * x + 0.5 * e)
    g = g.withColumns({"ema": ema, "mean": F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), "average": F.round(F.col("total") / span, 2).cast("double")})
    sigma = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / (F.size("v") - 1))
    j = g.withColumn("slow", F.greatest(F.lit(1.0), F.col("ema") - sigma)).join(goals.where(F.col("target_amount") > F.col("current_amount")), ["user_id", "goal_id"])
    missing = (F.col("target_amount") - F.col("current_amount")).cast("double")
    p50 = F.greatest(F.lit(1), F.ceil(missing / F.col("ema")))
    j = j.withColumns({"p50_months": p50, "p90_months": F.greatest(p50, F.ceil(missing / F.col("slow")))})
    near = (F.col("average") <= 0) | (F.abs(F.col("ema") - F.col("average")) / F.greatest(F.lit(1.0), F.col("average")) < 0.10)
    trend = F.when(near, "STEADY").when(F.col("ema") > F.col("average"), "ACCELERATING").otherwise("DECELERATING")
    return j.where("ema > 0").select("goal_id", "user_id", F.round("ema", 2).alias("ema"), "p50_months", "p90_months", trend.alias("trend"))


MILESTONES = (25, 50, 75, 100)


def milestones(progress: DataFrame) -> DataFrame:
    """A row for each milestone of a goal: reached or not, and the amount that it stands for."""
    each = progress.withColumn("milestone", F.explode(F.array(*[F.lit(m) for m in MILESTONES])))
    return each.select("goal_id", "user_id", "milestone", (F.col("percent") >= F.col("milestone")).alias("reached"), money(F.col("target_amount") * F.col("milestone") / 100).alias("amount"))


def crossed_milestones(progress: DataFrame, goals: DataFrame) -> DataFrame:
    """The highest milestone that a goal has newly crossed."""
    top = F.lit(0)
    for m in MILESTONES:
        top = F.when(F.col("percent") >= m, m).otherwise(top)
    j = progress.join(goals.where("NOT completed").select("user_id", "goal_id", "last_milestone"), ["user_id", "goal_id"])
    return j.withColumn("milestone", top).where("milestone > last_milestone").select("goal_id", "user_id", "percent", "milestone")


def recommendations(tx: DataFrame, accounts: DataFrame, goals: DataFrame, as_of: str) -> DataFrame:
    """Goals worth adding, by a user's health, without the types that the user already has."""
    h = financial_health(tx, accounts, as_of)
    branches = F.array(
        F.when(F.col("emergency_progress") < 1, F.struct(F.lit("EMERGENCY_FUND").alias("goal_type"), money(F.col("expense") * 6 * (1 - F.col("emergency_progress"))).alias("target"))),
        F.when(F.col("debt_to_income") > 0.36, F.struct(F.lit("DEBT_PAYOFF").alias("goal_type"), money(F.col("income") * 12 * (F.col("debt_to_income") - F.lit("0.36").cast("decimal(3,2)"))).alias("target"))),
        F.when(F.col("savings_rate") < 0.20, F.struct(F.lit("SAVINGS_RATE").alias("goal_type"), money(F.col("income") * (F.lit("0.20").cast("decimal(3,2)") - F.col("savings_rate"))).alias("target"))),
        F.when(F.col("income") - F.col("expense") * F.lit("0.7").cast("decimal(2,1)") > 0, F.struct(F.lit("WANTS_BUDGET").alias("goal_type"), money(F.col("income") * F.lit("0.20").cast("decimal(3,2)")).alias("target"))),
        F.when(F.col("income") > 0, F.struct(F.lit("RETIREMENT").alias("goal_type"), money(F.col("income") * 12 * F.lit("0.15").cast("decimal(3,2)")).alias("target"))),
    )
    rows = h.select("user_id", F.explode(F.filter(branches, lambda b: b.isNotNull())).alias("b")).select("user_id", "b.*")
    return rows.join(goals.select("user_id", "goal_type").distinct(), ["user_id", "goal_type"], "left_anti")


def planner(tx: DataFrame, accounts: DataFrame, goals: DataFrame, as_of: str, price: int) -> DataFrame:
    """Whether a user can buy something now: safe money is liquid less a month's usual expense and the goals' monthly needs."""
    liquid = accounts.where("active").where(F.lower("account_type").rlike("checking|savings|money_market")).groupBy("user_id").agg(total(F.col("balance")).alias("liquid"))
    need = goals.where("NOT completed").groupBy("user_id").agg(total(F.col("monthly_contribution")).alias("goal_need"))
    j = liquid.join(median_monthly_income_expense(tx, as_of), "user_id").join(need, "user_id", "left")
    safe = F.greatest(F.lit(0), F.col("liquid") - F.col("median_expense") - F.coalesce("goal_need", F.lit(0))).cast("decimal(19,2)")
    verdict = F.when(F.col("safe") >= price, "YES").when(F.col("liquid") >= price, "WAIT").otherwise("NO")
    delay = F.when(F.coalesce("goal_need", F.lit(0)) > 0, F.ceil(F.greatest(F.lit(price) - F.col("safe"), F.lit(0)) / F.col("goal_need"))).otherwise(0)
    return j.withColumn("safe", safe).select("user_id", "liquid", "safe", verdict.alias("verdict"), delay.cast("int").alias("months_delayed"), ratio(F.lit(price).cast("decimal(19,2)"), F.col("liquid")).alias("share"))
