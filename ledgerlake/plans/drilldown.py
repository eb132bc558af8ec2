"""Registered drill-downs (row P13): filters over what other queries find, for all users."""

from pyspark.sql import functions as F

from ledgerlake.operators import subscriptions as S
from ledgerlake.plans import aggregates, anomalies, budgets  # noqa: F401  (their queries are filtered here)
from ledgerlake.plans.subscriptions import _MONTHLY
from ledgerlake.registry import query_of, register, sql_of


@register("p13_subscriptions_over", "subscription_id s, user_id l, monthly m", "subscriptions", f"SELECT * FROM (SELECT subscription_id, user_id, {_MONTHLY} AS monthly FROM subscriptions WHERE active) WHERE monthly >= 40")
def _(subscriptions):
    return subscriptions.where("active").withColumn("monthly", S.monthly_cost()).where("monthly >= 40")


@register("p13_budgets_over", "budget_id s, user_id l, used m", sql=f"SELECT budget_id, user_id, used FROM ({sql_of('b01_budget_summary')}) WHERE used >= 0.5")
def _(spark, sf_dir):
    return query_of("b01_budget_summary")(spark, sf_dir).where("used >= 0.5")


@register("p13_anomalies_by_severity", "user_id l, transaction_id s, kind s, amount m", sql=f"SELECT * FROM ({sql_of('d06_anomalies')}) WHERE severity = 'HIGH'")
def _(spark, sf_dir):
    return query_of("d06_anomalies")(spark, sf_dir).where(F.col("severity") == "HIGH")


@register("p13_category_totals", "user_id l, category s, total m", "tx", "SELECT user_id, lower(category_primary) AS category, sum(-amount) AS total FROM tx WHERE NOT deleted AND amount < 0 AND category_primary IS NOT NULL AND transaction_date BETWEEN DATE '2001-08-01' - 90 AND DATE '2001-08-01' AND lower(category_primary) IN ('dining', 'travel') GROUP BY 1, 2")
def _(tx):
    days = F.col("transaction_date").between(F.date_add(F.lit("2001-08-01").cast("date"), -90), F.lit("2001-08-01").cast("date"))
    rows = tx.where("NOT deleted AND amount < 0").where(days).withColumn("category", F.lower("category_primary")).where(F.col("category").isin("dining", "travel"))
    return rows.groupBy("user_id", "category").agg(F.sum(-F.col("amount")).alias("total"))
