"""Subscriptions: detection, lifecycle, prices, scores and savings (rows D14 to D28, J05, J06, J14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.cleaning import pattern_key
from ledgerlake.functions.dates import UNUSED_DAYS, day, next_payment, roll_forward
from ledgerlake.functions.filters import between, not_deleted
from ledgerlake.functions.money import cents_median, money, total
from ledgerlake.functions.text import lengths_fit, levenshtein_similarity, merchant_key, normalized_merchant
from ledgerlake.operators.clusters import alike, cut, heads
from ledgerlake.operators.recurrence import frequency, gaps

#: What makes a charge a candidate, what rules it out, and the rows that each frequency needs.
CANDIDATE_CATEGORIES = ("subscriptions", "streaming", "software", "membership", "cloud_storage", "tech", "entertainment", "health", "insurance", "education")
CANDIDATE_DETAILS = ("subscription", "membership", "recurring", "streaming", "software", "cloud")
CANDIDATE_WORDS = ("subscription", "membership", "recurring", "monthly", "annual", "yearly")
EXCLUDED_CATEGORIES = ("loan_payments", "transfer_in", "transfer_out", "transfer", "bank_fees", "investment", "investments", "income")
EXCLUDED_DETAILS = ("credit_card_payment", "loan_payment", "mortgage", "student_loan", "auto_payment", "personal_loan", "transfer", "withdrawal", "deposit", "investment", "brokerage", "retirement", "401k", "ira", "cd_deposit", "treasury")
EXCLUDED_WORDS = ("payment thank you", "credit card payment", "card payment", "autopay", "ach payment", "loan payment", "mortgage", "transfer", "online payment", "bill payment", "cd deposit", "brokerage deposit", "401k contribution", "ira contribution", "investment purchase")
#: Days between payments that make a cohort a candidate, and how far the mean gap and the amounts may be off.
COHORT_DAYS, COHORT_SLACK, COHORT_SPREAD = (7, 14, 15, 30, 31, 60, 90, 180, 365), 5, 10
LEAST_ROWS = {"DAILY": 35, "WEEKLY": 6, "BI_WEEKLY": 4, "MONTHLY": 4, "QUARTERLY": 3, "SEMI_ANNUAL": 2, "ANNUAL": 2}


def _by_frequency(values: dict, default) -> Column:
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(F.col("frequency") == name, F.lit(v)).otherwise(out)
    return out


def monthly_cost(amount: str = "amount", factors: tuple = (30.4375, 30.4375 / 7, 30.4375 / 14)) -> Column:
    """An amount a month: daily, weekly and biweekly by the given factors."""
    f = dict(zip(("DAILY", "WEEKLY", "BI_WEEKLY"), factors, strict=True)) | {"MONTHLY": 1.0, "QUARTERLY": 1.0 / 3, "SEMI_ANNUAL": 1.0 / 6, "ANNUAL": 1.0 / 12}
    return F.round((F.col(amount).cast("double") * _by_frequency(f, 1.0)).cast("decimal(19,6)"), 2).cast("decimal(19,2)")


def _cents(amount: str) -> Column:
    return (F.abs(amount) * 100).cast("bigint")


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def candidates(tx: DataFrame) -> DataFrame:
    """The columns that detect() needs of expenses that may be subscriptions: by category or description, or in a cohort of one name and whole amount with a steady rhythm.

    A cohort has three rows or more, a mean gap within COHORT_SLACK days of one of COHORT_DAYS, and amounts within a tenth of their mean.
    """
    kept = ["user_id", "transaction_id", "transaction_date", "merchant_name", "description", "amount"]
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    # Columns of their own and no filter: the texts are built and searched once a row.
    texts = tx.where("amount < 0").select(*kept, low("category_primary").alias("p"), low("category_detailed").alias("d"), low("description").alias("t"), F.concat(low("merchant_name"), F.lit(" "), low("description")).alias("both"))
    primary, detailed, described, both = (F.col(c) for c in ("p", "d", "t", "both"))
    excluded = primary.isin(*EXCLUDED_CATEGORIES) | primary.contains("transfer") | primary.contains("loan_payment") | _has_any(detailed, EXCLUDED_DETAILS) | _has_any(both, EXCLUDED_WORDS)
    wanted = primary.isin(*CANDIDATE_CATEGORIES) | _has_any(detailed, CANDIDATE_DETAILS) | _has_any(described, CANDIDATE_WORDS)
    told = texts.select(*kept, excluded.alias("excluded"), wanted.alias("wanted"), _cents("amount").alias("cents"), pattern_key(F.col("merchant_name"), F.col("description")).alias("pattern"))
    rows = cut(told).where("NOT excluded").withColumn("whole", F.floor((F.col("cents") + 50) / 100))
    # Sums before the shuffle; the few steady cohorts come back to the rows.
    cohorts = rows.where("pattern IS NOT NULL").groupBy("user_id", "pattern", "whole").agg(F.count("*").alias("n"), F.sum("cents").alias("s"), F.min("cents").alias("low"), F.max("cents").alias("high"), F.datediff(F.max("transaction_date"), F.min("transaction_date")).alias("days"))
    steps = F.col("n") - 1
    rhythm = F.exists(F.array(*[F.lit(c) for c in COHORT_DAYS]), lambda c: F.abs(F.col("days") - c * steps) <= COHORT_SLACK * steps)
    even = (COHORT_SPREAD * (F.col("high") * F.col("n") - F.col("s")) <= F.col("s")) & (COHORT_SPREAD * (F.col("s") - F.col("low") * F.col("n")) <= F.col("s"))
    steady = cohorts.where((F.col("n") >= 3) & (F.col("s") >= F.col("n")) & rhythm & even).select("user_id", "pattern", "whole")
    told = rows.join(steady.withColumn("steady", F.lit(True)), ["user_id", "pattern", "whole"], "left")
    return told.where(F.col("wanted") | F.coalesce("steady", F.lit(False))).select(kept)


#: Days of a month that a subscription is often charged on; from this share of the rows on they make it monthly.
CHARGE_DAY_SHARE, LEAST_DATES = 0.7, 3
#: From this share of the rows on dates are regular: one weekday; days of a month or months of a year near one of them.
REGULAR_SHARE, NEAR_DAYS, NEAR_MONTHS = 0.8, 2, 1


def date_counts() -> list[Column]:
    """Aggregates over transaction_date: rows by weekday, day of month and month, and by the usual charge days (first, middle, last)."""
    date, dom = F.col("transaction_date"), F.dayofmonth("transaction_date")
    counted = lambda values, of: F.array(*[F.count_if(of == v) for v in values])
    first, middle = dom <= 3, dom.between(14, 16)
    last = dom >= F.dayofmonth(F.last_day(date)) - 2
    return [
        counted(range(1, 8), F.dayofweek(date)).alias("weekdays"),
        counted(range(1, 32), dom).alias("days"),
        counted(range(1, 13), F.month(date)).alias("months"),
        F.greatest(F.count_if(first), F.count_if(middle), F.count_if(last & ~first & ~middle)).alias("charge_days"),
    ]


def full_frequency() -> Column:
    """By the median gap; where that is none, monthly if the rows fall on one of the usual charge days."""
    usual = (F.col("n") >= LEAST_DATES) & (F.col("charge_days") >= CHARGE_DAY_SHARE * F.col("n"))
    return F.coalesce(frequency(F.col("gap")), F.when(usual, "MONTHLY"))


def regular_dates() -> Column:
    """Whether the dates keep to an anchor: weekly ones to a weekday, monthly ones to days near one day, yearly ones to months near one month."""

    def most_near(counts: str, size: int, near) -> Column:
        around = lambda anchor: F.aggregate(F.transform(F.col(counts), lambda n, i: F.when(near(i, anchor), n).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
        anchors = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(F.col(counts), i) > 0)
        return F.array_max(F.transform(anchors, around))

    by_day = most_near("days", 31, lambda i, a: F.abs(i - a) <= NEAR_DAYS)
    by_month = most_near("months", 12, lambda i, a: (F.abs(i - a) <= NEAR_MONTHS) | (F.abs(i - a) >= 12 - NEAR_MONTHS))
    most = F.when(F.col("frequency").isin("WEEKLY", "BI_WEEKLY"), F.array_max("weekdays")).when(F.col("frequency") == "ANNUAL", by_month).otherwise(by_day)
    return (F.col("frequency") == "DAILY") | (most >= REGULAR_SHARE * F.col("n"))


def detect(tx: DataFrame) -> DataFrame:
    """Groups of one exact amount at one merchant, alike merchants of a user taken together, with a frequency, enough rows and regular dates.

    Rows without a merchant group by their description and stay apart from merchants. A group is told under the merchant of its first row.
    """
    named, described = F.trim(F.coalesce("merchant_name", F.lit(""))) != "", F.trim(F.coalesce("description", F.lit(""))) != ""
    label = F.when(named, merchant_key(F.col("merchant_name"))).when(described, merchant_key(F.col("description"))).otherwise("unknown")
    rows = cut(candidates(tx)).withColumn("name", F.when(named, normalized_merchant(F.col("merchant_name")))).withColumn("label", label).withColumn("price", F.abs("amount").cast("decimal(19,2)"))
    merged = heads(alike(rows.where(named).select("user_id", F.col("name").alias("merchant")).distinct())).withColumnRenamed("merchant", "name")
    own = F.when(named, F.concat(F.lit("m:"), F.coalesce("cluster", "name"))).otherwise(F.concat(F.lit("d:"), F.when(described, normalized_merchant(F.col("description"))).otherwise("UNKNOWN")))
    rows = rows.join(merged, ["user_id", "name"], "left").withColumn("group", own)
    g = gaps(rows, "user_id", "group", "price").groupBy("user_id", "group", "price").agg(F.min_by("label", F.struct("transaction_date", "transaction_id")).alias("merchant"), F.count("*").alias("n"), F.median("gap").alias("gap"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"), *date_counts())
    g = g.where("n >= 2").withColumn("frequency", full_frequency()).where("frequency IS NOT NULL")
    g = g.where((F.col("n") >= _by_frequency(LEAST_ROWS, 99)) & regular_dates())
    return g.withColumn("next_date", next_payment(F.col("last_date"), F.col("frequency"))).select("user_id", "merchant", "price", "n", "gap", "first_date", "last_date", "frequency", "next_date")


def consolidate(found: DataFrame) -> DataFrame:
    """One subscription a merchant and frequency: the latest price holds; three or more prices spread over 1.5 are a variable bill."""
    prices = F.array_sort(F.collect_list(F.struct("last_date", "price")))
    g = found.groupBy("user_id", "merchant", "frequency").agg(prices.alias("history"), F.count_distinct("price").alias("n_prices"), F.min("price").alias("low"), F.max("price").alias("high"), cents_median(F.col("price")).alias("predicted"), F.min("first_date").alias("start_date"), F.max("last_date").alias("last_payment_date"), F.sum("n").alias("n"))
    variable = (F.col("n_prices") >= 3) & (F.col("high") > F.col("low") * F.lit("1.5").cast("decimal(3,1)"))
    history = F.array_join(F.transform("history", lambda h: F.concat_ws("@", h["price"].cast("string"), h["last_date"].cast("string"))), ",")
    return g.where(~variable).select("user_id", "merchant", "frequency", F.element_at("history", -1)["price"].alias("amount"), "n_prices", history.alias("price_history"), "predicted", "start_date", "last_payment_date", "n", next_payment(F.col("last_payment_date"), F.col("frequency")).alias("next_payment_date"))


def lifecycle(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """ACTIVE, and from once, one and a half times (whole days) and twice the unused days after the last payment on the states of disuse."""
    days = F.datediff(day(as_of), "last_payment_date")
    limit = _by_frequency(UNUSED_DAYS, 60)
    state = F.when(F.col("quiet") >= 2 * F.col("limit"), "PRESUMED_CANCELLED").when(F.col("quiet") >= F.expr("3 * limit div 2"), "UNUSED_2_CYCLES").when(F.col("quiet") >= F.col("limit"), "UNUSED_1_CYCLE").otherwise("ACTIVE")
    return subscriptions.where("active").withColumns({"quiet": days, "limit": limit}).select("subscription_id", "user_id", "quiet", state.alias("state"))


def matched_payments(subscriptions: DataFrame, tx: DataFrame, least: float = 0.8, off: str = "0.05") -> DataFrame:
    """Expenses of a user whose merchant is like the subscription's and whose amount is within 5 %.

    Merchants, not rows, are compared: distinct names of a user against the user's subscriptions, where the lengths allow it.
    """
    subs = subscriptions.select("subscription_id", "user_id", merchant_key(F.col("merchant_name")).alias("key"), F.col("amount").alias("price"))
    rows = tx.where((F.col("amount") < 0) & F.col("merchant_name").isNotNull()).withColumn("name", merchant_key(F.col("merchant_name")))
    names = rows.select("user_id", "name").distinct()
    alike = subs.join(names, "user_id").where(lengths_fit(F.col("key"), F.col("name"), least)).where(levenshtein_similarity(F.col("key"), F.col("name")) >= least).select("subscription_id", "user_id", "name", "price")
    paid = rows.select("user_id", "name", "transaction_id", "transaction_date", F.abs("amount").alias("spent"))
    close = F.abs(F.col("spent") - F.col("price")) <= F.col("price") * F.lit(off).cast("decimal(5,2)")
    return alike.join(paid, ["user_id", "name"]).where(close)


def unused(subscriptions: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """HIGH without any matching payment, MEDIUM if the next payment is overdue by more than the unused days."""
    subs = subscriptions.where("active").withColumns({"limit": _by_frequency(UNUSED_DAYS, 60), "next_date": next_payment(F.col("last_payment_date"), F.col("frequency"))})
    seen = matched_payments(subs, tx).groupBy("subscription_id").agg(F.count("*").alias("n_payments"))
    j = subs.join(seen, "subscription_id", "left")
    level = F.when(F.col("n_payments").isNull(), "HIGH").when(F.datediff(day(as_of), "next_date") > F.col("limit"), "MEDIUM")
    return j.withColumn("severity", level).where("severity IS NOT NULL").select("subscription_id", "user_id", "merchant_name", "amount", "severity", monthly_cost().alias("monthly"))


def price_changes(subscriptions: DataFrame, least: int = 5) -> DataFrame:
    """Prices that moved by more than 5 % against the last known one."""
    rows = subscriptions.where("active AND previous_price IS NOT NULL AND previous_price > 0")
    pct = F.round((F.col("amount") - F.col("previous_price")).cast("decimal(19,2)") / F.col("previous_price") * 100, 2)
    return rows.withColumn("percent", pct).where(F.abs("percent") > least).select("subscription_id", "user_id", "previous_price", "amount", "percent", F.when(F.col("percent") > 0, "INCREASE").otherwise("DECREASE").alias("direction"))


def costlier_duplicates(subscriptions: DataFrame) -> DataFrame:
    """Active subscriptions of a merchant that cost more a month than the user's cheapest of that merchant."""
    subs = subscriptions.where("active").withColumn("merchant", merchant_key(F.col("merchant_name"))).withColumn("monthly", monthly_cost())
    w = Window.partitionBy("user_id", "merchant")
    return subs.withColumn("cheapest", F.min("monthly").over(w)).where("monthly > cheapest").select("subscription_id", "user_id", "merchant", "monthly", (F.col("monthly") - F.col("cheapest")).cast("decimal(19,2)").alias("saving"))


def cancellations(subscriptions: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """Unused subscriptions and costlier duplicates; a subscription that is both counts as unused."""
    idle = unused(subscriptions, tx, as_of).select("subscription_id", "user_id", F.lit("UNUSED").alias("reason"), F.col("monthly").alias("saving"))
    twice = costlier_duplicates(subscriptions).select("subscription_id", "user_id", F.lit("DUPLICATE").alias("reason"), "saving")
    return idle.unionByName(twice.join(idle.select("subscription_id"), "subscription_id", "left_anti"))


#: Days between payments that the health score expects.
EXPECTED_DAYS = {"MONTHLY": 30, "QUARTERLY": 90, "SEMI_ANNUAL": 180, "ANNUAL": 365}


def health(subscriptions: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """100 less penalties: no payment for more than twice the expected days 30, for 1.5 times 15, no payment known 20; the last of its
    payments (same name, amount within 5 %) more than 10 % from the first 10; another active subscription of the merchant 20."""
    subs = subscriptions.where("active").withColumns({"name": F.upper(F.trim("merchant_name")), "price": F.abs("amount")})
    paid = tx.where(F.col("merchant_name").isNotNull() & F.col("amount").isNotNull()).select("user_id", F.upper(F.trim("merchant_name")).alias("name"), F.abs("amount").alias("spent"), _cents("amount").alias("cents"), F.struct("transaction_date", "transaction_id").alias("at"))
    close = F.abs(F.col("spent") - F.col("price")) <= F.col("price") * F.lit("0.05").cast("decimal(5,2)")
    moved = subs.select("subscription_id", "user_id", "name", "price").join(paid, ["user_id", "name"]).where(close).groupBy("subscription_id").agg(F.count("*").alias("n"), F.min_by("cents", "at").alias("first"), F.max_by("cents", "at").alias("last"))
    change = F.expr("(2 * 10000 * abs(last - first) + first) div (2 * first)")  # ten-thousandths, half up
    moved = moved.where("n >= 2 AND first > 0").select("subscription_id", F.when(change > 1000, 10).otherwise(0).alias("moved"))
    twice = subscriptions.where("active").groupBy("user_id", F.lower("merchant_name").alias("merchant")).agg(F.count("*").alias("n")).where("n > 1").select("user_id", "merchant", F.lit(20).alias("twice"))
    quiet, expected = F.datediff(day(as_of), "last_payment_date"), _by_frequency(EXPECTED_DAYS, 30)
    late = F.when(quiet.isNull(), 20).when(quiet > 2 * expected, 30).when(2 * quiet > 3 * expected, 15).otherwise(0)
    j = subs.withColumn("merchant", F.lower("merchant_name")).join(moved, "subscription_id", "left").join(twice, ["user_id", "merchant"], "left")
    j = j.withColumn("score", 100 - late - F.coalesce("moved", F.lit(0)) - F.coalesce("twice", F.lit(0)))
    level = F.when(F.col("score") >= 80, "EXCELLENT").when(F.col("score") >= 60, "GOOD").when(F.col("score") >= 40, "FAIR").otherwise("POOR")
    return j.select("subscription_id", "user_id", "score", level.alias("level"))


def predictive_cancellation(subscriptions: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """How likely a subscription should go: 90 if unused, else what is missing to 100 when its score is under 50."""
    idle = unused(subscriptions, tx, as_of).select("subscription_id", F.lit(90).alias("idle"))
    scored = health(subscriptions, tx, as_of).join(idle, "subscription_id", "left")
    p = F.coalesce("idle", F.when(F.col("score") < 50, 100 - F.col("score")))
    return scored.withColumn("likelihood", p).where("likelihood IS NOT NULL").select("subscription_id", "user_id", "score", "likelihood")


def trials(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Trials that end within two weeks; without a known end, the first payment plus 7, 14 or 30 days within three days."""
    subs = subscriptions.where("active")
    known = subs.where(F.datediff("trial_ends_at", day(as_of)).between(0, 14)).select("subscription_id", "user_id", F.col("trial_ends_at").alias("ends"), F.lit("KNOWN").alias("source"))
    guessed = subs.where("trial_ends_at IS NULL").select("subscription_id", "user_id", F.explode(F.array(*[F.date_add("start_date", d) for d in (7, 14, 30)])).alias("ends"), F.lit("GUESSED").alias("source"))
    return known.unionByName(guessed.where(F.datediff("ends", day(as_of)).between(0, 3)))


#: Fixed values of the offer table: group -> name parts and the share that a bundle costs.
BUNDLES = {"video": (("streamly 0", "streamly 1", "streamly 2", "streamly 3"), "0.80"), "mixed": (("merchant 1", "merchant 2", "streamly 4"), "0.85")}


def bundles(subscriptions: DataFrame, groups: dict = BUNDLES) -> DataFrame:
    """Users with two or more subscriptions of a bundle group, and what the bundle saves."""
    rules = subscriptions.sparkSession.createDataFrame([(g, part, share) for g, (parts, share) in groups.items() for part in parts], "bundle string, part string, share string")
    subs = subscriptions.where("active").withColumn("monthly", monthly_cost()).withColumn("name", F.lower("merchant_name"))
    hits = subs.join(F.broadcast(rules), F.expr("contains(name, part)")).select("user_id", "bundle", "share", "subscription_id", "monthly").distinct()
    g = hits.groupBy("user_id", "bundle", "share").agg(F.count("*").alias("n"), total(F.col("monthly")).alias("total")).where("n >= 2")
    return g.select("user_id", "bundle", "n", "total", money(F.col("total") * (1 - F.col("share").cast("decimal(3,2)"))).alias("saving"))


def renewals(subscriptions: DataFrame, as_of: str, days: int = 30, days_long: int = 14) -> DataFrame:
    """Next billing dates within 30 days (14 for annual and semi-annual ones), stepping on from the last payment."""
    rows = subscriptions.where("active AND amount > 0").withColumn("billing", roll_forward(F.col("last_payment_date"), F.col("frequency"), day(as_of)))
    limit = F.when(F.col("frequency").isin("ANNUAL", "SEMI_ANNUAL"), days_long).otherwise(days)
    return rows.withColumn("days_until", F.datediff("billing", day(as_of))).where((F.col("days_until") >= 0) & (F.col("days_until") <= limit)).select("subscription_id", "user_id", "billing", "days_until", monthly_cost().alias("monthly"))


#: What a frequency's cents are multiplied with and divided by for ten-thousandths (daily: millionths) a month of 30.4375 days.
_MONTH_PARTS = {"WEEKLY": (304375, 700), "BI_WEEKLY": (304375, 1400), "QUARTERLY": (100, 3), "SEMI_ANNUAL": (100, 6), "ANNUAL": (100, 12)}


def _monthly_millionths() -> Column:
    """A month's cost in millionths: daily and monthly ones exact, others rounded half up at four places."""
    cents = _cents("amount")
    out = cents * 10000
    for name, (up, down) in _MONTH_PARTS.items():
        out = F.when(F.col("frequency") == name, F.floor((2 * cents * up + down) / (2 * down)) * 100).otherwise(out)
    return F.when(F.col("frequency") == "DAILY", cents * 304375).otherwise(out)


def creep(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Monthly cost of all active subscriptions against that of those which began 30 days ago or earlier (or at an unknown time).

    The share is 1 where nothing was there before.
    """
    rows = subscriptions.where("active AND amount > 0").withColumn("m", _monthly_millionths())
    old = F.col("start_date").isNull() | (F.datediff(day(as_of), "start_date") >= 30)
    g = rows.groupBy("user_id").agg(F.sum("m").alias("all_m"), F.coalesce(F.sum(F.when(old, F.col("m"))), F.lit(0)).alias("old_m"))
    g = g.withColumns({"now_c": F.expr("(all_m + 5000) div 10000"), "before_c": F.expr("(old_m + 5000) div 10000")})
    parts = F.when(F.col("old_m") == 0, 10000).otherwise(F.expr("(2 * (now_c - before_c) * 100000000 + old_m) div (2 * old_m)"))
    share = (parts.cast("decimal(19,0)") / 10000).cast("decimal(19,4)")
    g = g.withColumn("share", share)
    label = F.when(F.col("share") >= 0.15, "SPIKING").when(F.col("share") >= 0.05, "CREEPING").when(F.col("share") <= -0.05, "SHRINKING").otherwise("STABLE")
    return g.select("user_id", (F.col("now_c").cast("decimal(19,0)") / 100).cast("decimal(19,2)").alias("now"), (F.col("before_c").cast("decimal(19,0)") / 100).cast("decimal(19,2)").alias("before"), "share", label.alias("trend"))


#: Days between charges that the engagement score expects.
CADENCE_DAYS = {"DAILY": 1, "WEEKLY": 7, "BI_WEEKLY": 14, "MONTHLY": 30, "QUARTERLY": 90, "SEMI_ANNUAL": 180, "ANNUAL": 365}


def engagement(subscriptions: DataFrame, tx: DataFrame, as_of: str, window: int = 90) -> DataFrame:
    """0.45 recency, 0.25 frequency, 0.15 price stability and 0.15 for being active, over a user's charges of that name in the window.

    Recency falls from 1 to 0 at twice the cadence; frequency is 1 from three quarters of the expected charges on, and falls to the
    ratio itself at a half; stability falls from 1 at a price variation of 0.05 to 0 at 0.50. Inactive ones are DORMANT.
    """
    cadence = _by_frequency(CADENCE_DAYS, 30)
    subs = subscriptions.withColumns({"key": merchant_key(F.col("merchant_name")), "cadence": cadence, "expected": F.floor(F.lit(90) / cadence)})
    rows = tx.where(not_deleted() & F.col("merchant_name").isNotNull() & between("transaction_date", F.date_add(day(as_of), -window), as_of)).withColumn("key", merchant_key(F.col("merchant_name")))
    prices = F.sort_array(F.collect_set(_cents("amount")))
    g = rows.groupBy("user_id", "key").agg(F.count("*").alias("n"), F.max("transaction_date").alias("last"), F.sum(_cents("amount")).alias("cents"), F.count("amount").alias("n_amounts"), prices.alias("prices"))
    # The mean at four places, half up, in ten-thousandths; squares of the deviations as exact numbers.
    g = g.withColumn("mean", F.expr("(2 * 100 * cents + n_amounts) div (2 * n_amounts)"))
    squares = F.aggregate("prices", F.lit(0).cast("decimal(38,0)"), lambda s, p: (s + ((p * 100 - F.col("mean")) * (p * 100 - F.col("mean"))).cast("decimal(20,0)")).cast("decimal(38,0)"))
    cv = F.sqrt(squares.cast("double") / F.size("prices")) / F.greatest(F.lit(100.0), F.col("mean").cast("double"))
    steady = F.when((F.col("n") < 2) | (F.size("prices") <= 1) | (F.col("mean") == 0), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (cv - 0.05) / 0.45)))
    j = subs.join(g.withColumn("steady", steady), ["user_id", "key"], "left")
    recency = F.when(F.col("last").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.datediff(day(as_of), "last") / (2.0 * F.col("cadence")))))
    ratio = F.coalesce("n", F.lit(0)) / F.col("expected")
    often = F.when(F.col("expected") <= 0, F.col("n").isNotNull().cast("double")).when(ratio >= 0.75, 1.0).when(ratio <= 0.5, ratio).otherwise(0.5 + (ratio - 0.5) * 2)
    score = F.floor((0.45 * recency + 0.25 * often + 0.15 * F.coalesce("steady", F.lit(1.0)) + 0.15 * F.col("active").cast("double")) * 100 + 0.5)
    tier = F.when(~F.col("active") | (F.col("score") < 40), "DORMANT").when(F.col("score") >= 70, "ACTIVE").otherwise("AT_RISK")
    return j.where("merchant_name IS NOT NULL").withColumn("score", score).select("subscription_id", "user_id", "score", tier.alias("tier"))


def portfolio(subscriptions: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """A user's monthly cost and what cancellations and bundles would save."""
    cost = subscriptions.where("active").groupBy("user_id").agg(total(monthly_cost()).alias("monthly"), F.count("*").alias("n"))
    cut = cancellations(subscriptions, tx, as_of).groupBy("user_id").agg(total(F.col("saving")).alias("cut"))
    bundled = bundles(subscriptions).groupBy("user_id").agg(total(F.col("saving")).alias("bundled"))
    zero = F.lit(0).cast("decimal(19,2)")
    return cost.join(cut, "user_id", "left").join(bundled, "user_id", "left").select("user_id", "n", "monthly", F.coalesce("cut", zero).alias("cancel_saving"), F.coalesce("bundled", zero).alias("bundle_saving"))
