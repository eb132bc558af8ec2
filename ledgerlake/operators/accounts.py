"""Cards, interest and balances (rows X09, X10, X12, X15, P09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.dates import day
from ledgerlake.functions.filters import between, not_deleted
from ledgerlake.functions.money import money, ratio, total, total_if

#: Interest words, and the rates assumed for loans.
INTEREST_WORDS = r"\b(interest|finance\s*charge)\b"
DEFAULT_APR = {"autoLoan": "0.08", "personalLoan": "0.15", "studentLoan": "0.06", "other": "0.10"}


def card_insights(accounts: DataFrame, as_of: str) -> DataFrame:
    """PAST_DUE, HIGH_UTILIZATION (over 30 %, over 70 %), AUTOPAY_OFF (only if said so), ANNUAL_FEE within 30 days; a row each."""
    cards = accounts.where("active AND account_type = 'creditCard'")
    used = ratio(F.abs("balance"), F.col("credit_limit"))
    cards = cards.withColumn("used", used)
    fee_days = F.datediff("annual_fee_due", day(as_of))
    found = F.array(
        F.when(F.col("past_due_amount") > 0, F.struct(F.lit("PAST_DUE").alias("kind"), F.lit("HIGH").alias("severity"), F.col("past_due_amount").cast("double").alias("value"))),
        F.when(F.col("used") > 0.30, F.struct(F.lit("HIGH_UTILIZATION").alias("kind"), F.when(F.col("used") > 0.70, "HIGH").otherwise("MEDIUM").alias("severity"), F.col("used").cast("double").alias("value"))),
        F.when(F.col("autopay_enabled").eqNullSafe(F.lit(False)), F.struct(F.lit("AUTOPAY_OFF").alias("kind"), F.lit("LOW").alias("severity"), F.lit(0.0).alias("value"))),
        F.when((F.col("annual_fee") > 0) & fee_days.between(0, 30), F.struct(F.lit("ANNUAL_FEE").alias("kind"), F.lit("LOW").alias("severity"), F.col("annual_fee").cast("double").alias("value"))),
    )
    return cards.select("user_id", "account_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("user_id", "account_id", "f.*")


def interest_paid(tx: DataFrame) -> DataFrame:
    """Interest charged by account, and per month that has any."""
    text = F.lower(F.concat_ws(" ", "category_primary", "category_detailed", "description"))
    rows = tx.where((F.col("amount") < 0) & text.rlike(INTEREST_WORDS))
    g = rows.groupBy("user_id", "account_id").agg(total(F.abs("amount")).alias("paid"), F.count_distinct(F.trunc("transaction_date", "month")).alias("months"))
    return g.withColumn("monthly", money(F.col("paid") / F.col("months")))


def high_interest(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts whose interest is worth acting on: by charges, cards by their APR (from 15 %, over 500 a year), loans by a usual rate (over 1000)."""
    charged = interest_paid(tx).join(accounts.select("account_id", "account_type"), "account_id").select("user_id", "account_id", F.lit("CHARGED").alias("source"), (F.col("monthly") * 12).cast("decimal(19,2)").alias("annual"))
    rate = F.col("apr_percent") / 100
    cards = accounts.where("account_type = 'creditCard' AND apr_percent >= 15").select("user_id", "account_id", F.lit("CARD_APR").alias("source"), money(F.abs("balance") * rate).alias("annual")).where("annual > 500")
    apr = F.lit(None).cast("decimal(5,2)")
    for kind, r in DEFAULT_APR.items():
        apr = F.when(F.col("account_type") == kind, F.lit(r).cast("decimal(5,2)")).otherwise(apr)
    loans = accounts.where("balance < 0").withColumn("apr", apr).where("apr IS NOT NULL").select("user_id", "account_id", F.lit("LOAN_RATE").alias("source"), money(F.abs("balance") * F.col("apr")).alias("annual")).where("annual > 1000")
    return charged.unionByName(cards).unionByName(loans)


def balance_drift(balances: DataFrame, accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """The change between two readings of an account's balance, one after the other, that its transactions of these days don't explain.

    balances: account_id, snapshot_date, balance. Both days count. Of liabilities the sum counts negated. The transactions of a day are summed
    before they meet the readings; one running sum an account then gives every reading the sum up to it. The first reading has nothing before it
    and no row; days with several readings count with their largest; rows without a balance, an account or a day are left out.
    """
    readings = balances.where("account_id IS NOT NULL AND snapshot_date IS NOT NULL AND balance IS NOT NULL").groupBy("account_id", "snapshot_date").agg(F.max("balance").alias("balance"))
    days = tx.where(not_deleted() & F.col("account_id").isNotNull()).groupBy("account_id", F.col("transaction_date").alias("snapshot_date")).agg(total(F.col("amount")).alias("moved"))
    line = Window.partitionBy("account_id").orderBy("snapshot_date")
    both = readings.join(days, ["account_id", "snapshot_date"], "full").withColumn("moved", F.coalesce("moved", F.lit(0)).cast("decimal(19,2)"))
    upto = both.withColumn("upto", F.sum("moved").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("balance IS NOT NULL")
    before = lambda c: F.lag(c).over(line)
    pairs = upto.select("account_id", "snapshot_date", before("snapshot_date").alias("since"), (F.col("balance") - before("balance")).alias("change"), (F.col("upto") - before("upto") + before("moved")).alias("moved"))
    kind = F.lower(F.coalesce("account_type", F.lit("")))
    liability = kind.contains("credit") | kind.contains("loan") | kind.contains("mortgage")
    joined = pairs.where("since IS NOT NULL").join(accounts.select("account_id", "user_id", "account_type"), "account_id")
    explained = F.when(liability, -F.col("moved")).otherwise(F.col("moved")).cast("decimal(19,2)")
    told = joined.withColumn("explained", explained).withColumn("drift", (F.col("change") - F.col("explained")).cast("decimal(19,2)"))
    return told.select("account_id", "user_id", "since", "snapshot_date", "change", "explained", "drift", F.when(F.abs("drift") >= 10, "WARN").when(F.abs("drift") >= 1, "INFO").alias("level"))


def daily_read(accounts: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """ALERT from half of all card limits used, CAUTION from 30 %, or with liquid money under a third of the month's outflow; else STEADY."""
    cards = F.col("account_type") == "creditCard"
    sides = accounts.where("active").groupBy("user_id").agg(total_if(cards, F.abs("balance")).alias("owed"), total_if(cards, F.col("credit_limit")).alias("limits"), total_if(F.lower("account_type").isin("checking", "savings"), F.col("balance")).alias("liquid"))
    kinds = F.lower(F.coalesce("category_primary", F.lit("")))
    out = tx.where(not_deleted() & (F.col("amount") < 0) & ~kinds.isin("transfer", "payment") & between("transaction_date", F.date_add(day(as_of), -30), as_of)).groupBy("user_id").agg(total(F.abs("amount")).alias("outflow"))
    j = sides.join(out, "user_id", "left").withColumn("outflow", F.coalesce("outflow", F.lit(0)).cast("decimal(19,2)")).withColumn("used", ratio(F.col("owed"), F.col("limits")))
    state = F.when(F.col("used") >= 0.5, "ALERT").when(F.col("used") >= 0.3, "CAUTION").when(F.col("liquid") < F.col("outflow") * F.lit("0.33").cast("decimal(3,2)"), "CAUTION").otherwise("STEADY")
    return j.select("user_id", "used", "liquid", "outflow", state.alias("state"))


def account_payments(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Payments into loans (inflows), and into cards (inflows, or of the category payment)."""
    j = tx.join(accounts.select("account_id", "account_type"), "account_id")
    loan = F.col("account_type").isin("mortgage", "autoLoan", "personalLoan", "studentLoan") & (F.col("amount") > 0)
    card = (F.col("account_type") == "creditCard") & ((F.col("amount") > 0) | F.lower(F.coalesce("category_primary", F.lit(""))).contains("payment"))
    return j.where(loan | card).select("account_id", "account_type", "transaction_id", "amount")
