"""Summaries over several operators, merchant clusters and account matches (rows A24, A26, A27, D22, D27, J17, J20, P12, P14, S10, S11, T06)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.dates import day
from ledgerlake.functions.filters import between, not_deleted
from ledgerlake.functions.money import money, total, total_if
from ledgerlake.functions.text import jaro_winkler_similarity, lengths_fit, merchant_key


def insights_summary(found: dict[str, DataFrame], savings: DataFrame) -> DataFrame:
    """A user's number of findings of each detector, how many are HIGH, and twelve times the monthly savings."""
    parts = [df.select("user_id", F.lit(name).alias("detector"), (F.col("severity") if "severity" in df.columns else F.lit("LOW")).alias("severity")) for name, df in found.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy("user_id").agg(*[F.count_if(F.col("detector") == n).alias(n) for n in found], F.count_if(F.col("severity") == "HIGH").alias("high"))
    saved = savings.groupBy("user_id").agg((total(F.col("saving")) * 12).cast("decimal(19,2)").alias("annual_savings"))
    return counts.join(saved, "user_id", "left").select("user_id", *found, "high", F.coalesce("annual_savings", F.lit(0)).cast("decimal(19,2)").alias("annual_savings"))


def privacy_snapshot(tx: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Spend by month and category of the last 90 days in whole tens, without merchants that fewer than three rows name."""
    rows = tx.where(not_deleted() & (F.col("amount") < 0) & between("transaction_date", F.date_add(day(as_of), -days), as_of))
    known = rows.groupBy("user_id", "merchant_name").agg(F.count("*").alias("n")).where("n >= 3 AND merchant_name IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("known_merchants"))
    g = rows.groupBy("user_id", F.trunc("transaction_date", "month").alias("month"), F.coalesce("category_primary", F.lit("other")).alias("category")).agg((F.round(total(F.abs("amount")) / 10, 0) * 10).cast("bigint").alias("spent"), F.count("*").alias("n"))
    return g.join(known, "user_id", "left").select("user_id", "month", "category", "spent", "n", F.coalesce("known_merchants", F.lit(0)).alias("known_merchants"))


def miss_ranking(imports: DataFrame) -> DataFrame:
    """Imports that failed or were partial, by status: how often, and the mean of the rows that were read all the same."""
    return imports.where("status <> 'COMPLETED'").groupBy("user_id", "status").agg(F.count("*").alias("misses"), F.round(F.avg("successful"), 4).alias("mean_rows"))


def alternatives(subscriptions: DataFrame, offers: list[tuple[str, str, str]]) -> DataFrame:
    """Cheaper offers of a subscription's category, the cheapest first."""
    table = subscriptions.sparkSession.createDataFrame(offers, "category string, offer string, offer_price string").withColumn("offer_price", F.col("offer_price").cast("decimal(19,2)"))
    j = subscriptions.where("active AND frequency = 'MONTHLY'").join(F.broadcast(table), "category").where("offer_price < amount")
    place = Window.partitionBy("subscription_id").orderBy("offer_price", "offer")
    return j.withColumn("place", F.row_number().over(place)).select("subscription_id", "user_id", "offer", (F.col("amount") - F.col("offer_price")).cast("decimal(19,2)").alias("saving"), "place")


def merchant_clusters(tx: DataFrame, least: float = 0.90) -> DataFrame:
    """A user's merchant keys in clusters: in order of name, each key that no cluster has yet takes those from 0.90 on by Jaro-Winkler.

    One pass, as in the source system; a merged key draws no further ones. Alike names are found by a join, and only they form a user's group.
    """
    names = tx.where("merchant_name IS NOT NULL").select("user_id", merchant_key(F.col("merchant_name")).alias("merchant")).distinct()
    # A prefix adds at most 0.4 of what Jaro leaves, and Jaro is at most (2 + shorter / longer) / 3.
    share = 3 * (least - 0.4) / 0.6 - 2
    pairs = names.withColumnRenamed("merchant", "head").join(names, "user_id").where(F.col("head") < F.col("merchant")).where(lengths_fit(F.col("head"), F.col("merchant"), share))
    pairs = pairs.where(jaro_winkler_similarity(F.col("head"), F.col("merchant")) >= least).select("user_id", "head", "merchant")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = {}
        for head, name in sorted(zip(pdf["head"], pdf["merchant"], strict=True)):
            if head not in taken:
                taken.setdefault(name, head)
        return pd.DataFrame({"user_id": pdf.user_id.iloc[0], "cluster": list(taken.values()), "merchant": list(taken)})

    taken = pairs.groupBy("user_id").applyInPandas(cluster, "user_id bigint, cluster string, merchant string")
    return names.join(taken, ["user_id", "merchant"], "left").select("user_id", F.coalesce("cluster", "merchant").alias("cluster"), "merchant")


def match_accounts(detected: DataFrame, accounts: DataFrame) -> DataFrame:
    """The user's account that fits a detected one best: name and institution, then institution and type, then type alone."""
    a = accounts.select(F.col("user_id").alias("a_user"), "account_id", F.lower("account_name").alias("a_name"), F.lower("institution_name").alias("a_bank"), F.col("account_type").alias("a_type"))
    j = detected.join(a, F.col("user_id") == F.col("a_user"))
    same_bank = F.lower("institution") == F.col("a_bank")
    rank = F.when(same_bank & (F.lower("name") == F.col("a_name")), 1).when(same_bank & (F.col("type") == F.col("a_type")), 2).when(F.col("type") == F.col("a_type"), 3)
    best = Window.partitionBy("detected_id").orderBy("rank", "account_id")
    return j.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("r", F.row_number().over(best)).where("r = 1").select("detected_id", "account_id", "rank")


#: Days between payments that count as a cadence, and how far a mean gap may be off.
CADENCES, CADENCE_SLACK, AMOUNT_SLACK = (7, 14, 15, 30, 31, 60, 90, 180, 365), 5, "0.10"


def cadence_groups(tx: DataFrame) -> DataFrame:
    """Merchants whose mean gap is within five days of a cadence and whose amounts stay within a tenth of their mean."""
    rows = tx.where(F.col("merchant_name").isNotNull() & (F.col("amount") < 0))
    order = Window.partitionBy("user_id", "merchant_name").orderBy("transaction_date", "transaction_id")
    g = rows.withColumn("gap", F.datediff("transaction_date", F.lag("transaction_date").over(order))).groupBy("user_id", "merchant_name").agg(F.count("*").alias("n"), F.avg("gap").alias("gap"), money(F.avg(F.abs("amount"))).alias("mean"), F.min(F.abs("amount")).alias("low"), F.max(F.abs("amount")).alias("high"))
    near = F.exists(F.array(*[F.lit(c) for c in CADENCES]), lambda c: F.abs(F.col("gap") - c) <= CADENCE_SLACK)
    slack = F.col("mean") * F.lit(AMOUNT_SLACK).cast("decimal(3,2)")
    return g.where((F.col("n") >= 3) & near & (F.col("high") - F.col("mean") <= slack) & (F.col("mean") - F.col("low") <= slack)).select("user_id", "merchant_name", "n", F.round("gap", 4).alias("gap"), "mean")


def resumable(imports: DataFrame) -> DataFrame:
    return imports.where("status IN ('FAILED', 'PARTIAL') AND successful > 0").select("import_id", "user_id", "status", "successful")


def user_accounts(accounts: DataFrame, user_id: int | None = None, kind: str | None = None) -> DataFrame:
    """Each user's accounts (or one user's), once each, of a kind if one is given."""
    rows = accounts if user_id is None else accounts.where(F.col("user_id") == user_id)
    rows = rows.dropDuplicates(["account_id"])
    return rows.where(F.col("account_type") == kind) if kind else rows


def user_budgets(budgets: DataFrame, user_id: int | None = None, category: str | None = None, rolling: bool = False) -> DataFrame:
    """Each user's budgets (or one user's), of a category and with rollover if asked for."""
    rows = budgets if user_id is None else budgets.where(F.col("user_id") == user_id)
    rows = rows.where(F.lower("category") == category.lower()) if category else rows
    return rows.where("rollover_enabled") if rolling else rows


def ranked(found: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """A user's findings in order, as `place`: (column, descending) in turn. Order travels as a column, as no table keeps one."""
    by = [F.desc_nulls_last(c) if descending else F.asc_nulls_last(c) for c, descending in order]
    return found.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*by)))


def daily_totals(tx: DataFrame, start: str, end: str) -> DataFrame:
    """Spend and running spend of each day that has rows."""
    rows = tx.where(not_deleted() & between("transaction_date", start, end)).groupBy("user_id", "transaction_date").agg(total_if(F.col("amount") < 0, F.abs("amount")).alias("spent"))
    so_far = Window.partitionBy("user_id").orderBy("transaction_date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("so_far", F.sum("spent").over(so_far).cast("decimal(19,2)"))


def usage_likelihood(vectors: DataFrame) -> DataFrame:
    """1 - the mean cosine of a vector to the others of its label, from sums of unit vectors: no pairs are formed."""
    unit = F.expr("transform(embedding, x -> CAST(x AS DOUBLE) / sqrt(aggregate(embedding, 0D, (s, v) -> s + CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))")
    rows = vectors.where("size(embedding) > 0").select("vec_id", "label", unit.alias("u"))
    sums = rows.select("label", F.posexplode("u")).groupBy("label", "pos").agg(F.sum("col").alias("s"))
    whole = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("whole"))
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    dot: Column = F.aggregate(F.zip_with("u", "whole", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    j = rows.join(whole, "label").join(n, "label").where("n > 1")
    return j.select("vec_id", F.round(1 - (dot - 1) / (F.col("n") - 1), 6).alias("unlikely"))
