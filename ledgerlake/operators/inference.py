"""Transaction types, merchant codes and token clusters (rows F34, F36, C02, C03, C10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.categorise import MERCHANT_CODES

#: Account kinds, and the words that decide within them.
KINDS = {"card": ("creditcard", "credit", "credit_card", "charge_card"), "investment": ("investment", "brokerage", "401k", "ira", "hsa", "529"), "loan": ("loan", "mortgage", "autoloan", "personalloan", "studentloan"), "deposit": ("checking", "savings", "money_market", "cash")}
FEE_WORDS = ("fee", "charge", "commission", "tax", "custodial", "maintenance", "sales load", "expense ratio")
RECEIVED_WORDS = ("payment received", "payment thank you", "thank you for your payment", "autopay payment")
CARD_PAYMENT_WORDS = ("credit card payment", "card payment", "cardmember", "epay", "autopay")


def account_kind(c: Column) -> Column:
    out = F.lit(None)
    for kind, names in KINDS.items():
        out = F.when(F.lower(F.trim(c)).isin(*names), kind).otherwise(out)
    return out


def transaction_type(kind: Column, amount: Column, description: Column) -> Column:
    """(type, confidence) by account kind, sign and words; where the account doesn't tell, by sign at 0.60; null for 0."""
    text = F.lower(F.trim(F.coalesce(description, F.lit(""))))
    has = lambda words: text.rlike("|".join(words))
    result = lambda t, sure=0.95: F.struct(F.lit(t).alias("type"), F.lit(sure).alias("confidence"))
    inflow, outflow = amount > 0, amount < 0
    return (
        F.when(amount.isNull() | (amount == 0), None)
        .when((kind == "card") & inflow & ~has(RECEIVED_WORDS), result("EXPENSE"))
        .when(kind == "card", result("PAYMENT"))
        .when((kind == "investment") & inflow, result("INCOME"))
        .when((kind == "investment") & has(FEE_WORDS), result("EXPENSE"))
        .when(kind == "investment", result("INVESTMENT"))
        .when((kind == "loan") & outflow, result("EXPENSE"))
        .when((kind == "loan") & has(RECEIVED_WORDS), result("PAYMENT"))
        .when(kind == "loan", result("PAYMENT", 0.90))
        .when((kind == "deposit") & inflow, result("INCOME"))
        .when((kind == "deposit") & has(CARD_PAYMENT_WORDS), result("PAYMENT"))
        .when(kind == "deposit", result("EXPENSE"))
        .when(inflow, result("INCOME", 0.60))
        .otherwise(result("EXPENSE", 0.60))
    )


def typed(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    j = tx.join(accounts.select("account_id", account_kind(F.col("account_type")).alias("kind")), "account_id", "left")
    return j.withColumn("t", transaction_type(F.col("kind"), F.col("amount"), F.col("description"))).select("transaction_id", "kind", "t.type", "t.confidence")


def by_merchant_code(rows: DataFrame, codes: list = MERCHANT_CODES) -> DataFrame:
    """rows(transaction_id, code) -> category of the code, where the directory has it."""
    table = rows.sparkSession.createDataFrame(codes, "code int, category string")
    return rows.join(F.broadcast(table), "code").select("transaction_id", "code", "category")


#: Token clusters: a category and the words that speak for it.
CLUSTERS = {"streaming": ("streamly", "subscription", "video"), "salary": ("payroll", "deposit", "salary"), "shopping": ("merchant", "store", "pos"), "utilities": ("power", "water", "medium")}


def semantic_match(tx: DataFrame, clusters: dict = CLUSTERS, least: float = 0.05, boost: float = 0.1) -> DataFrame:
    """The cluster with the largest share of common words, a row of the same category adding a boost; ties by name."""
    table = tx.sparkSession.createDataFrame([(k, list(v)) for k, v in clusters.items()], "cluster string, words array<string>")
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "merchant_name", "description")), r"[^a-z]+"), lambda t: t != ""))
    rows = tx.select("transaction_id", F.lower("category_primary").alias("own"), tokens.alias("tokens"))
    # the clusters are a handful of rows: each word finds its clusters by equality
    words = rows.select("transaction_id", "own", F.size("tokens").alias("n"), F.explode("tokens").alias("word"))
    hits = words.join(F.broadcast(table.select("cluster", F.size("words").alias("m"), F.explode("words").alias("word"))), "word")
    g = hits.groupBy("transaction_id", "own", "cluster", "n", "m").agg(F.count("*").alias("k"))
    score = F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")) + F.when(F.col("own") == F.col("cluster"), boost).otherwise(0.0), 6)
    best = g.withColumn("score", score).where(F.col("score") >= least).groupBy("transaction_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "cluster")).alias("b"))
    return best.select("transaction_id", F.col("b.cluster").alias("cluster"), (-F.col("b.s")).alias("score"))
