"""Anomaly detectors (rows D01 to D07, P11, A12): each yields transaction_id, user_id, kind, severity, amount, so that they can be united."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.dates import day
from ledgerlake.functions.filters import between, effective_category, not_deleted, not_hidden
from ledgerlake.functions.money import cents_median, money, round_to
from ledgerlake.functions.text import merchant_or_description
from ledgerlake.operators.aggregates import cross_account_rows

#: Categories whose merchants are no surprise.
RECURRING = ("rent", "rent_and_utilities", "mortgage", "loan", "loan_payment", "utilities", "insurance", "tax", "interest_charged", "interest")
SENSITIVITY = {"LOOSE": 1.5, "NORMAL": 1.0, "STRICT": 0.7}
COLUMNS = ("user_id", "transaction_id", "kind", "severity", "amount")


def expenses(tx: DataFrame) -> DataFrame:
    rows = tx.where(not_deleted() & not_hidden() & (F.col("amount") < 0))
    return rows.withColumns({"spent": F.abs("amount").cast("decimal(19,2)"), "merchant": F.lower(merchant_or_description()), "category": F.lower(effective_category("other"))})


def recent_rows(rows: DataFrame, as_of: str) -> DataFrame:
    return rows.where(between("transaction_date", F.date_add(day(as_of), -90), as_of))


def history_rows(rows: DataFrame, as_of: str) -> DataFrame:
    """From 180 to 90 days back; the day 90 back belongs to both."""
    return rows.where(between("transaction_date", F.date_add(day(as_of), -180), F.date_add(day(as_of), -90)))


def with_sensitivity(rows: DataFrame, preferences: DataFrame) -> DataFrame:
    s = F.lit(1.0)
    for name, factor in SENSITIVITY.items():
        s = F.when(F.col("anomaly_sensitivity") == name, factor).otherwise(s)
    return rows.join(preferences.select("user_id", s.alias("sensitivity")), "user_id", "left").withColumn("sensitivity", F.coalesce("sensitivity", F.lit(1.0)))


def deviation(c: str) -> tuple[Column, Column]:
    """Population mean and deviation with the roundings in between: mean to 2 places, variance and root to 4."""
    mean = F.round(F.avg(c), 2).cast("decimal(19,2)")
    # avg((x - m)^2) = avg(x^2) - 2 m avg(x) + m^2 for the rounded m
    n, s, ss = F.count(c), F.sum(c), F.sum((F.col(c) * F.col(c)).cast("decimal(38,4)"))
    return mean, F.struct(n.alias("n"), s.alias("s"), ss.alias("ss"))


def _rooted(mean: str, sums: str) -> Column:
    m = F.col(mean).cast("double")
    n, s, ss = (F.col(f"{sums}.{k}").cast("double") for k in ("n", "s", "ss"))
    return F.round(F.sqrt(F.greatest(F.round((ss - 2 * m * s + n * m * m) / n, 4), F.lit(0.0))), 4)


def statistical_outliers(tx: DataFrame, preferences: DataFrame, as_of: str, z: float = 2.5) -> DataFrame:
    """Recent expenses more than z deviations from the history's mean; needs ten rows on both sides."""
    rows = expenses(tx)
    mean, sums = deviation("spent")
    past = history_rows(rows, as_of).groupBy("user_id").agg(mean.alias("mean"), sums.alias("sums")).where("sums.n >= 10").withColumn("sigma", _rooted("mean", "sums")).where("sigma > 0")
    recent = recent_rows(rows, as_of)
    enough = recent.groupBy("user_id").count().where("count >= 10").select("user_id")
    joined = with_sensitivity(recent.join(enough, "user_id", "left_semi").join(past, "user_id"), preferences)
    far = F.abs((F.col("spent").cast("double") - F.col("mean").cast("double")) / F.col("sigma")) > z * F.col("sensitivity")
    return joined.where(far).select("user_id", "transaction_id", F.lit("OUTLIER").alias("kind"), F.when(F.col("spent") > 500, "HIGH").otherwise("MEDIUM").alias("severity"), F.col("spent").alias("amount"))


def category_spikes(tx: DataFrame, preferences: DataFrame, as_of: str, times: float = 3.0) -> DataFrame:
    """The largest recent expense of a category whose recent mean is so many times the history's."""
    rows = expenses(tx)
    past = history_rows(rows, as_of).groupBy("user_id", "category").agg(money(F.avg("spent")).alias("past"))
    now = recent_rows(rows, as_of).groupBy("user_id", "category").agg(money(F.avg("spent")).alias("now"), F.max(F.struct("spent", "transaction_id")).alias("top"))
    joined = with_sensitivity(now.join(past, ["user_id", "category"]), preferences).where("past > 0").where(F.col("now").cast("double") > times * F.col("sensitivity") * F.col("past").cast("double"))
    return joined.select("user_id", F.col("top.transaction_id").alias("transaction_id"), F.lit("CATEGORY_SPIKE").alias("kind"), F.lit("MEDIUM").alias("severity"), F.col("top.spent").alias("amount"))


def first_time_merchants(tx: DataFrame, as_of: str, least: int = 100) -> DataFrame:
    """The first row of a merchant that is neither in the history nor earlier in the recent rows."""
    rows = expenses(tx).where("merchant IS NOT NULL AND merchant <> ''")
    known = history_rows(rows, as_of).select("user_id", "merchant").distinct()
    first = Window.partitionBy("user_id", "merchant").orderBy("transaction_date", "transaction_id")
    new = recent_rows(rows, as_of).withColumn("r", F.row_number().over(first)).where("r = 1").join(known, ["user_id", "merchant"], "left_anti")
    return new.where((F.col("spent") > least) & ~F.col("category").isin(*RECURRING)).select("user_id", "transaction_id", F.lit("NEW_MERCHANT").alias("kind"), F.lit("LOW").alias("severity"), F.col("spent").alias("amount"))


def duplicate_charges(tx: DataFrame, as_of: str, least: int = 50, days: int = 1) -> DataFrame:
    """The earlier of two charges of one merchant and $5 bucket at most a day apart."""
    rows = recent_rows(expenses(tx), as_of).where((F.col("spent") >= least) & F.col("merchant").isNotNull())
    order = Window.partitionBy("user_id", "merchant", "bucket").orderBy("transaction_date", "transaction_id")
    rows = rows.withColumn("bucket", round_to(F.col("spent"), 5)).withColumn("next", F.lead("transaction_date").over(order))
    return rows.where(F.datediff("next", "transaction_date") <= days).select("user_id", "transaction_id", F.lit("DUPLICATE").alias("kind"), F.lit("HIGH").alias("severity"), F.col("spent").alias("amount"))


def over_median(tx: DataFrame, preferences: DataFrame, as_of: str, times: float = 5.0) -> DataFrame:
    rows = expenses(tx)
    past = history_rows(rows, as_of).groupBy("user_id").agg(cents_median(F.col("spent")).alias("median")).where("median > 0")
    joined = with_sensitivity(recent_rows(rows, as_of).join(past, "user_id"), preferences)
    return joined.where(F.col("spent").cast("double") > times * F.col("sensitivity") * F.col("median").cast("double")).select("user_id", "transaction_id", F.lit("THRESHOLD").alias("kind"), F.when(F.col("spent") > 1000, "HIGH").otherwise("MEDIUM").alias("severity"), F.col("spent").alias("amount"))


def fingerprints(tx: DataFrame) -> DataFrame:
    """transaction_id -> merchant|category|amount to the nearest 20."""
    return expenses(tx).select("user_id", "transaction_id", _fingerprint().alias("fingerprint"))


def _fingerprint() -> Column:
    return F.concat_ws("|", "merchant", "category", round_to(F.col("spent"), 20).cast("bigint").cast("string"))


def rank_of(severity: Column) -> Column:
    return F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).otherwise(1)


def findings(tx: DataFrame, preferences: DataFrame, as_of: str, z: float = 2.5, spike: float = 3.0, new: int = 100, twice: int = 50, twice_days: int = 1, median: float = 5.0) -> DataFrame:
    """All five detectors in one pass over the rows: user_id, transaction_id, spent, fingerprint and an array of (kind, severity).

    Statistics a user and a category are two aggregations of the same 180 days; what looks at a merchant's other rows are windows that
    share one shuffle.
    """
    recent, past = F.col("transaction_date") >= F.date_add(day(as_of), -90), F.col("transaction_date") <= F.date_add(day(as_of), -90)
    rows = expenses(tx.where(between("transaction_date", F.date_add(day(as_of), -180), as_of))).withColumns({"recent": recent, "past_spent": F.when(past, F.col("spent")), "now_spent": F.when(recent, F.col("spent"))})
    rows = rows.select("user_id", "transaction_id", "transaction_date", "merchant", "category", "spent", "recent", "past_spent", "now_spent")
    mean, sums = deviation("past_spent")
    users = rows.groupBy("user_id").agg(mean.alias("mean"), sums.alias("sums"), cents_median(F.col("past_spent")).alias("median"), F.count_if("recent").alias("n_recent"))
    users = with_sensitivity(users.withColumn("sigma", F.when(F.col("sums.n") >= 10, _rooted("mean", "sums"))), preferences)
    spikes = rows.groupBy("user_id", "category").agg(money(F.avg("past_spent")).alias("past"), money(F.avg("now_spent")).alias("now"), F.max(F.when(F.col("recent"), F.struct("spent", "transaction_id"))).alias("top")).where("past > 0 AND now IS NOT NULL")
    by_merchant = Window.partitionBy("user_id", "merchant")
    enough = F.col("recent") & (F.col("spent") >= twice)
    in_bucket = Window.partitionBy("user_id", "merchant", "enough", "bucket").orderBy("transaction_date", "transaction_id")
    rows = rows.withColumns({"enough": enough, "bucket": round_to(F.col("spent"), 5)})
    rows = rows.withColumns({
        "known": F.max(F.col("past_spent").isNotNull()).over(by_merchant),
        "place": F.row_number().over(Window.partitionBy("user_id", "merchant", "recent").orderBy("transaction_date", "transaction_id")),
        "next": F.lead("transaction_date").over(in_bucket),
    })
    j = rows.where("recent").join(users, "user_id").join(spikes, ["user_id", "category"], "left")
    spent, sure = F.col("spent").cast("double"), F.col("sensitivity")
    found = lambda when, kind, severity: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))
    high = lambda least: F.when(F.col("spent") > least, "HIGH").otherwise("MEDIUM")
    far = (F.col("sigma") > 0) & (F.col("n_recent") >= 10) & (F.abs((spent - F.col("mean").cast("double")) / F.col("sigma")) > z * sure)
    named = F.col("merchant").isNotNull() & (F.col("merchant") != "")
    each = F.array(
        found(far, "OUTLIER", high(500)),
        found((F.col("now").cast("double") > spike * sure * F.col("past").cast("double")) & (F.col("top.transaction_id") == F.col("transaction_id")), "CATEGORY_SPIKE", F.lit("MEDIUM")),
        found(named & ~F.col("known") & (F.col("place") == 1) & (F.col("spent") > new) & ~F.col("category").isin(*RECURRING), "NEW_MERCHANT", F.lit("LOW")),
        found(F.col("merchant").isNotNull() & F.col("enough") & (F.datediff("next", "transaction_date") <= twice_days), "DUPLICATE", F.lit("HIGH")),
        found((F.col("median") > 0) & (spent > median * sure * F.col("median").cast("double")), "THRESHOLD", high(1000)),
    )
    out = j.select("user_id", "transaction_id", "spent", _fingerprint().alias("fingerprint"), F.filter(each, lambda f: f.isNotNull()).alias("found"))
    return out.where(F.size("found") > 0)


def anomalies(tx: DataFrame, preferences: DataFrame, feedback: DataFrame, as_of: str, **how) -> DataFrame:
    """All detectors, without dismissed fingerprints, the most severe finding of each transaction, in order of severity and amount."""
    dismissed = feedback.where("verdict = 'DISMISSED'").join(fingerprints(tx), ["user_id", "transaction_id"]).select("user_id", "fingerprint").distinct()
    open_ = findings(tx, preferences, as_of, **how).join(dismissed, ["user_id", "fingerprint"], "left_anti")
    best = F.array_min(F.transform("found", lambda f: F.struct((-rank_of(f["severity"])).alias("rank"), f["kind"].alias("kind"), f["severity"].alias("severity"))))
    one = open_.withColumn("best", best)
    place = Window.partitionBy("user_id").orderBy("best.rank", F.desc("spent"), "transaction_id")
    return one.select("user_id", "transaction_id", "best.kind", "best.severity", F.col("spent").alias("amount"), F.row_number().over(place).alias("place"))


def near_duplicates_across_accounts(tx: DataFrame, as_of: str, days: int = 14, reach: int = 3) -> DataFrame:
    """For each charge the nearest earlier one of the same merchant and whole amount on another account, at most 3 days back.

    In order of time that is the row before the present run of rows of one account, so one window finds it, however often a charge recurs.
    """
    rows = cross_account_rows(tx, as_of, days).withColumn("whole", F.round(F.abs("amount"), 0).cast("bigint")).select("user_id", "merchant", "whole", "transaction_id", "account_id", "transaction_date")
    order = Window.partitionBy("user_id", "merchant", "whole").orderBy("transaction_date", "transaction_id")
    before = F.lag(F.struct("transaction_date", "transaction_id", "account_id")).over(order)
    rows = rows.withColumn("before", before)
    other = F.when(F.col("before.account_id") != F.col("account_id"), F.col("before"))
    rows = rows.withColumn("other", F.last(other, ignorenulls=True).over(order))
    back = F.datediff("transaction_date", "other.transaction_date")
    return rows.where(back <= reach).select("user_id", "merchant", "transaction_id", F.col("other.transaction_id").alias("earlier_id"), back.alias("days_apart"))


def missed_pattern_breaks(tx: DataFrame, as_of: str, window: int = 90) -> DataFrame:
    """Regular charges (same merchant and amount, three or more, even gaps of a month or two weeks) that are a week late."""
    skip = ("dining", "groceries", "shopping", "transportation", "entertainment", "travel", "healthcare", "health", "personal_care", "other")
    rows = tx.where(not_hidden() & (F.col("amount") < 0) & between("transaction_date", F.date_add(day(as_of), -window), as_of))
    rows = rows.withColumns({"merchant": F.lower(merchant_or_description()), "category": F.lower(effective_category("other")), "spent": F.abs("amount")}).where(~F.col("category").isin(*skip))
    order = Window.partitionBy("user_id", "merchant", "spent").orderBy("transaction_date", "transaction_id")
    gaps = rows.withColumn("gap", F.datediff("transaction_date", F.lag("transaction_date").over(order)))
    g = gaps.groupBy("user_id", "merchant", "spent").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sigma"), F.max("transaction_date").alias("last"))
    regular = (F.col("n") >= 3) & (F.col("sigma") <= 4) & (F.col("mean").between(25, 35) | F.col("mean").between(12, 16))
    expected = F.date_add("last", F.floor("mean").cast("int"))
    return g.where(regular).withColumn("expected", expected).withColumn("days_late", F.datediff(day(as_of), "expected")).where("days_late > 7").select("user_id", "merchant", F.col("spent").alias("amount"), "n", "expected", "days_late")


def missed_actions(actions: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """Open actions that are overdue or due in three days, with no transaction within a week of the due date that names them."""
    open_ = actions.where(~F.col("is_completed") & (F.datediff("due_date", day(as_of)) <= 3)).withColumn("late", F.datediff(day(as_of), "due_date"))
    rows = tx.where("NOT deleted").select(F.col("user_id").alias("t_user"), "transaction_date", F.lower(F.concat_ws(" ", "merchant_name", "description")).alias("text"))
    # days are exploded on the side of the few open actions, so the join is on equality of user and day
    days = open_.withColumn("day", F.explode(F.sequence(F.date_add("due_date", -7), F.date_add("due_date", 7))))
    paid = days.join(rows, (F.col("user_id") == F.col("t_user")) & (F.col("day") == F.col("transaction_date"))).where(F.expr("contains(text, lower(title)) OR contains(text, lower(description))")).select("action_id").distinct()
    return open_.join(paid, "action_id", "left_anti").select("action_id", "user_id", "late", F.when(F.col("late") > 7, "HIGH").when(F.col("late") > 0, "MEDIUM").otherwise("LOW").alias("severity"))
