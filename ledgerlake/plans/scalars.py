"""Registered queries of scalar functions: dates, amounts, currencies, cycles, percentiles and statement fields (rows F12 to F16, F18, F19, F25, F40)."""

from pyspark.sql import functions as F

from ledgerlake.adapter import AS_OF
from ledgerlake.functions import dates as T
from ledgerlake.functions import masking as K
from ledgerlake.functions.money import nearest_rank
from ledgerlake.plans.subscriptions import _next
from ledgerlake.registry import register
from ledgerlake.sources import files

_D = "DATE '2001-08-01'"


def _place():
    """0 to 3, which form of a value a row's text takes."""
    return F.col("updated_at_ts") % 4


@register("f12_parsed_dates", "transaction_id s, parsed d", "tx", "SELECT transaction_id, CASE WHEN updated_at_ts % 4 = 3 THEN NULL ELSE transaction_date END AS parsed FROM tx")
def _(tx):
    d = F.col("transaction_date")
    text = F.when(_place() == 0, d.cast("string")).when(_place() == 1, F.date_format(d, "MM/dd/yyyy")).when(_place() == 2, F.date_format(d, "d MMM yyyy")).otherwise("no date")
    return tx.select("transaction_id", files.parse_date(text).alias("parsed"))


@register("f13_parsed_amounts", "transaction_id s, parsed m", "tx", "SELECT transaction_id, CASE updated_at_ts % 4 WHEN 0 THEN -abs(amount) WHEN 1 THEN abs(amount) WHEN 2 THEN -abs(amount) ELSE abs(amount) END AS parsed FROM tx")
def _(tx):
    a = F.abs("amount").cast("string")
    text = F.when(_place() == 0, F.concat(F.lit("("), a, F.lit(")"))).when(_place() == 1, F.concat(F.lit("$ "), a)).when(_place() == 2, F.concat(a, F.lit("-"))).otherwise(F.concat(F.lit("EUR "), F.replace(a, F.lit("."), F.lit(","))))
    return tx.select("transaction_id", files.parse_amount(text).alias("parsed"))


@register("f14_currencies", "transaction_id s, currency s", "tx", "SELECT transaction_id, CASE updated_at_ts % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'INR' ELSE 'USD' END AS currency FROM tx")
def _(tx):
    text = F.when(_place() == 0, "paid in eur").when(_place() == 1, "£5.00").otherwise("plain")
    return tx.select("transaction_id", files.detect_currency(text, F.lit("Amount"), F.when(_place() == 2, "export_inr_2001.csv").otherwise("export.csv")).alias("currency"))


@register("f15_cycles", "transaction_id s, begins d, ends d", "tx", """
SELECT transaction_id, CASE updated_at_ts % 4 WHEN 0 THEN CAST(date_trunc('week', transaction_date) AS DATE) WHEN 1 THEN DATE '2024-01-01' + CAST(trunc((transaction_date - DATE '2024-01-01') / 14.0) AS INT) * 14 ELSE CAST(date_trunc('month', transaction_date) AS DATE) END AS begins,
  CASE updated_at_ts % 4 WHEN 0 THEN CAST(date_trunc('week', transaction_date) AS DATE) + 6 WHEN 1 THEN DATE '2024-01-01' + CAST(trunc((transaction_date - DATE '2024-01-01') / 14.0) AS INT) * 14 + 13 ELSE last_day(transaction_date) END AS ends FROM tx""")
def _(tx):
    period = F.when(_place() == 0, "weekly").when(_place() == 1, "BiWeekly").otherwise("monthly")
    return tx.select("transaction_id", T.cycle_start(period, F.col("transaction_date")).alias("begins"), T.cycle_end(period, F.col("transaction_date")).alias("ends"))


@register("f16_monthly_budgets", "budget_id s, monthly m", "budgets", "SELECT budget_id, CASE lower(period) WHEN 'weekly' THEN (2 * CAST(monthly_limit * 100 AS BIGINT) * 304375 + 70000) // 140000 / 100.0 WHEN 'biweekly' THEN (2 * CAST(monthly_limit * 100 AS BIGINT) * 304375 + 140000) // 280000 / 100.0 ELSE monthly_limit END AS monthly FROM budgets")
def _(budgets):
    return budgets.select("budget_id", T.monthly_budget(F.col("monthly_limit"), F.col("period")).alias("monthly"))


@register("f18_next_payments", "subscription_id s, next_date d", "subscriptions", f"SELECT subscription_id, {_next('last_payment_date')} AS next_date FROM subscriptions")
def _(subscriptions):
    return subscriptions.select("subscription_id", T.next_payment(F.col("last_payment_date"), F.col("frequency")).alias("next_date"))


@register("f19_rolled_forward", "subscription_id s, billing d", "subscriptions", f"""
WITH st AS (SELECT subscription_id, frequency, last_payment_date AS pay_day, 0 AS hop FROM subscriptions UNION ALL SELECT subscription_id, frequency, {_next('pay_day')}, hop + 1 FROM st WHERE pay_day < {_D} AND hop < 60) SELECT subscription_id, arg_max(pay_day, hop) AS billing FROM st GROUP BY 1""")
def _(subscriptions):
    return subscriptions.select("subscription_id", T.roll_forward(F.col("last_payment_date"), F.col("frequency"), T.day(AS_OF)).alias("billing"))


@register("f25_nearest_ranks", "user_id l, p50 m, p90 m", "tx", "SELECT user_id, quantile_disc(abs(amount), 0.5) AS p50, quantile_disc(abs(amount), 0.9) AS p90 FROM tx WHERE amount < 0 GROUP BY 1")
def _(tx):
    return tx.where("amount < 0").withColumn("spent", F.abs("amount")).groupBy("user_id").agg(nearest_rank("spent", 0.5).alias("p50"), nearest_rank("spent", 0.9).alias("p90"))


@register("f40_statement_fields", "transaction_id s, points l, balance m", "tx", "SELECT transaction_id, CASE WHEN updated_at_ts % 4 = 0 THEN updated_at_ts END AS points, CASE WHEN updated_at_ts % 4 = 1 THEN abs(amount) END AS balance FROM tx")
def _(tx):
    line = F.when(_place() == 0, F.concat(F.lit("Rewards balance: "), F.format_number("updated_at_ts", 0))).when(_place() == 1, F.concat(F.lit("New Balance   $"), F.abs("amount").cast("string"))).otherwise("Minimum due 35.00")
    return tx.select("transaction_id", K.reward_points(line).alias("points"), K.statement_balance(line).alias("balance"))
