"""Canonical frames from the driver's tables.

Each frame is one SELECT that Spark and DuckDB both read; the two ways in which they differ (adding months, and how a table is
named) are filled in. Operators see canonical frames only. Money is cast to DECIMAL(19,2) here, once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The day on which every registered query runs; operators take it as an argument.
AS_OF = "2001-08-01"

FRAMES: dict[str, str] = {
    "tx": """
SELECT CAST(o_orderkey AS STRING) AS transaction_id, CAST(floor(o_custkey / 75) AS BIGINT) AS user_id, o_custkey * 10 + o_orderkey % 3 AS account_id,
       CAST(CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END * (CAST(round(o_totalprice * 100) AS BIGINT) % 250000) AS DECIMAL(12,0)) * 0.01 AS DECIMAL(19,2)) AS amount,
       'POS ' || upper('Merchant ' || CAST(o_orderkey % 25 AS STRING)) || ' #' || CAST(1000 + o_orderkey % 700 AS STRING) || ' - ' || o_orderpriority || CASE o_orderkey % 67 WHEN 1 THEN ' donation' WHEN 2 THEN ' property tax' WHEN 3 THEN ' dividend' WHEN 4 THEN ' zelle' WHEN 5 THEN ' mortgage interest' WHEN 6 THEN ' turbotax' WHEN 7 THEN ' university' WHEN 8 THEN ' dmv' WHEN 9 THEN ' state tax' WHEN 10 THEN ' county tax' WHEN 11 THEN ' medical' WHEN 12 THEN ' stock sale' WHEN 13 THEN ' rsu' WHEN 14 THEN ' wages' ELSE '' END AS description,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'Merchant ' || CAST(o_orderkey % 25 AS STRING) END AS merchant_name,
       CASE o_orderkey % 5 WHEN 0 THEN 'groceries' WHEN 1 THEN 'dining' WHEN 2 THEN 'shopping' WHEN 3 THEN 'utilities' ELSE CASE WHEN o_orderstatus = 'P' THEN 'income' ELSE 'travel' END END AS category_primary,
       CASE o_orderkey % 7 WHEN 0 THEN 'dining' WHEN 1 THEN 'interest charged' WHEN 2 THEN 'insurance' ELSE NULL END AS category_detailed,
       CAST(o_orderdate AS DATE) AS transaction_date, CASE WHEN o_orderkey % 30 = 0 THEN 'EUR' WHEN o_orderkey % 31 = 0 THEN '' ELSE 'USD' END AS currency_code,
       CASE WHEN o_orderkey % 3 = 0 THEN 'p' || CAST(o_orderkey - o_orderkey % 6 AS STRING) ELSE NULL END AS plaid_transaction_id,
       o_orderkey % 20 = 0 AS pending, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 40 = 0 END AS is_hidden,
       CASE WHEN o_orderkey % 9 = 0 THEN 'g' || CAST(o_custkey AS STRING) ELSE NULL END AS goal_id,
       CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey - 1 AS STRING) ELSE NULL END AS round_up_source_transaction_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'PLAID' WHEN 1 THEN 'CSV' WHEN 2 THEN 'PDF' ELSE NULL END AS import_source,
       1000000 + o_orderkey AS updated_at_ts, o_orderkey % 50 = 0 AS deleted, CASE WHEN o_orderkey % 23 = 0 THEN 'ACH' ELSE 'in store' END AS payment_channel,
       CASE WHEN o_orderkey % 71 = 0 THEN 'TRANSFER_OUT' WHEN o_orderkey % 73 = 0 THEN 'FOOD_AND_DRINK' ELSE NULL END AS importer_category_primary, CASE WHEN o_orderkey % 79 = 0 THEN 'TRANSFER_IN_DEPOSIT' ELSE NULL END AS importer_category_detailed
FROM {orders}
UNION ALL
SELECT 'r' || CAST(c_custkey AS STRING) || '-' || CAST(k AS STRING), CAST(floor(c_custkey / 75) AS BIGINT), c_custkey * 10,
       CAST(CASE WHEN c_custkey % 10 = 0 THEN -(9.99 + c_custkey % 30 + CASE WHEN c_custkey % 20 = 0 AND k < 3 THEN 2 ELSE 0 END) ELSE 1800 + c_custkey % 900 END AS DECIMAL(19,2)),
       CASE WHEN c_custkey % 10 = 0 THEN 'STREAMLY.COM monthly subscription ' || CAST(c_custkey % 8 AS STRING) ELSE 'ACH payroll deposit' END,
       CASE WHEN c_custkey % 10 = 0 THEN 'Streamly ' || CAST(c_custkey % 8 AS STRING) ELSE 'Payroll ' || CAST(c_custkey % 4 AS STRING) END,
       CASE WHEN c_custkey % 10 = 0 THEN 'subscriptions' ELSE 'salary' END, CASE WHEN c_custkey % 10 = 0 THEN 'streaming' ELSE NULL END,
       {add_months:DATE '2001-07-20', -k - CASE WHEN c_custkey % 50 = 0 THEN 2 ELSE 0 END}, 'USD', NULL, FALSE, FALSE, NULL, NULL, 'PLAID', 9000000 + c_custkey, FALSE, NULL, NULL, NULL
FROM {customer} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS months(k) WHERE c_custkey % 5 = 0""",
    "accounts": """
SELECT c_custkey * 10 + k AS account_id, CAST(floor(c_custkey / 75) AS BIGINT) AS user_id, c_name AS account_name, 'Bank ' || CAST(c_nationkey AS STRING) AS institution_name,
       CASE k WHEN 0 THEN 'checking' WHEN 1 THEN 'creditCard' ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'mortgage' WHEN 'AUTOMOBILE' THEN 'autoLoan' WHEN 'MACHINERY' THEN 'personalLoan' ELSE 'savings' END END AS account_type,
       CAST(CASE WHEN k = 1 THEN -abs(c_acctbal) WHEN k = 2 AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN -10 * abs(c_acctbal) ELSE c_acctbal END AS DECIMAL(19,2)) AS balance,
       CAST(CASE WHEN k = 1 THEN 2000 + 500 * (c_custkey % 20) ELSE NULL END AS DECIMAL(19,2)) AS credit_limit,
       CAST(CASE WHEN k = 1 AND c_custkey % 3 <> 0 THEN 14 + c_custkey % 12 ELSE NULL END AS DECIMAL(9,4)) AS apr_percent,
       CAST(CASE WHEN k = 1 AND c_custkey % 9 = 0 THEN 25 + c_custkey % 70 ELSE 0 END AS DECIMAL(19,2)) AS past_due_amount,
       CASE WHEN k <> 1 OR c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 4 = 1 END AS autopay_enabled,
       CAST(CASE WHEN k = 1 AND c_custkey % 5 = 0 THEN 95 ELSE 0 END AS DECIMAL(19,2)) AS annual_fee,
       CASE WHEN k = 1 THEN {add_days:DATE '2001-08-01', CAST(c_custkey % 60 AS INT)} ELSE NULL END AS annual_fee_due, c_custkey % 29 <> 0 AS active
FROM {customer} CROSS JOIN (VALUES (0), (1), (2)) AS kinds(k)""",
    "balances": """
SELECT c_custkey * 10 + kind AS account_id, {add_days:DATE '2001-05-01', CAST(reading * 30 + c_custkey % 3 AS INT)} AS snapshot_date, CAST(c_acctbal + reading * (c_custkey % 13) * 0.25 AS DECIMAL(19,2)) AS balance
FROM {customer} CROSS JOIN (VALUES (0), (1), (2)) AS kinds(kind) CROSS JOIN (VALUES (0), (1), (2), (3)) AS readings(reading) WHERE c_custkey % 4 < 3""",
    "budgets": """
SELECT 'b' || CAST(c_custkey AS STRING) AS budget_id, CAST(floor(c_custkey / 75) AS BIGINT) AS user_id,
       CASE c_custkey % 6 WHEN 0 THEN 'groceries' WHEN 1 THEN 'dining' WHEN 2 THEN 'shopping' WHEN 3 THEN 'utilities' WHEN 4 THEN 'travel' ELSE 'salary' END AS category,
       CAST(200 + 150 * (c_custkey % 25) AS DECIMAL(19,2)) AS monthly_limit, CASE c_custkey % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'biweekly' ELSE 'monthly' END AS period,
       CASE WHEN c_custkey % 12 = 0 THEN '' ELSE 'usd' END AS currency_code, c_custkey % 2 = 0 AS rollover_enabled, CAST(c_custkey % 5 * 10 AS DECIMAL(19,2)) AS carried_amount,
       CASE WHEN c_custkey % 3 = 0 THEN 'g' || CAST(c_custkey AS STRING) ELSE NULL END AS goal_id, CAST(CASE WHEN c_custkey % 3 = 0 THEN 50 + c_custkey % 40 ELSE 0 END AS DECIMAL(19,2)) AS goal_allocation,
       CAST(CASE c_custkey % 8 WHEN 0 THEN 75 WHEN 1 THEN 50 ELSE 0 END AS INT) AS last_alerted_threshold, CAST(c_custkey % 7 * 5 AS DECIMAL(19,2)) AS last_goal_funded
FROM {customer} WHERE c_custkey % 15 < 5""",
    "goals": """
SELECT 'g' || CAST(c_custkey AS STRING) AS goal_id, CAST(floor(c_custkey / 75) AS BIGINT) AS user_id, 'Goal ' || CAST(c_custkey AS STRING) AS name, CAST(500 + 250 * (c_custkey % 30) AS DECIMAL(19,2)) AS target_amount,
       CAST(c_custkey % 11 * 100 AS DECIMAL(19,2)) AS current_amount, {add_months:DATE '2001-08-01', CAST(c_custkey % 24 AS INT) - 3} AS target_date, CAST(20 + c_custkey % 80 AS DECIMAL(19,2)) AS monthly_contribution,
       CASE c_custkey % 4 WHEN 0 THEN 'EMERGENCY_FUND' WHEN 1 THEN 'DEBT_PAYOFF' WHEN 2 THEN 'VACATION' ELSE 'RETIREMENT' END AS goal_type, c_custkey * 10 AS linked_account_id,
       c_custkey % 2 = 0 AS round_up_enabled, c_custkey % 37 = 0 AS completed, CAST(c_custkey % 4 * 25 AS INT) AS last_milestone
FROM {customer} WHERE c_custkey % 3 = 0""",
    "subscriptions": """
SELECT 's' || CAST(c_custkey AS STRING) AS subscription_id, CAST(floor(c_custkey / 75) AS BIGINT) AS user_id, CASE WHEN c_custkey % 41 = 0 THEN 'Netflix' WHEN c_custkey % 43 = 0 THEN 'Adobe Creative Cloud' WHEN c_custkey % 47 = 0 THEN 'Verizon Wireless' WHEN c_custkey % 3 = 0 THEN 'Streamly ' || CAST(c_custkey % 8 AS STRING) ELSE 'Merchant ' || CAST(c_custkey % 25 AS STRING) END AS merchant_name,
       CAST(4.99 + c_custkey % 60 AS DECIMAL(19,2)) AS amount, CASE c_custkey % 7 WHEN 0 THEN 'DAILY' WHEN 1 THEN 'WEEKLY' WHEN 2 THEN 'BI_WEEKLY' WHEN 3 THEN 'MONTHLY' WHEN 4 THEN 'QUARTERLY' WHEN 5 THEN 'SEMI_ANNUAL' ELSE 'ANNUAL' END AS frequency,
       {add_days:DATE '2001-08-01', -CAST(1 + c_custkey % 500 AS INT)} AS start_date, {add_days:DATE '2001-08-01', -CAST(c_custkey % 200 AS INT)} AS last_payment_date,
       CASE c_custkey % 5 WHEN 0 THEN 'streaming' WHEN 1 THEN 'software' WHEN 2 THEN 'fitness' WHEN 3 THEN 'cloud_storage' ELSE 'insurance' END AS category, c_custkey % 6 <> 0 AS active,
       CASE WHEN c_custkey % 4 = 0 THEN CAST(4.99 + c_custkey % 60 - c_custkey % 3 AS DECIMAL(19,2)) ELSE NULL END AS previous_price,
       CASE WHEN c_custkey % 8 = 0 THEN {add_days:DATE '2001-08-01', CAST(c_custkey % 30 AS INT) - 5} ELSE NULL END AS trial_ends_at
FROM {customer}""",
    "actions": """
SELECT 'a' || CAST(o_orderkey AS STRING) AS action_id, CAST(floor(o_custkey / 75) AS BIGINT) AS user_id, 'merchant ' || CAST(o_orderkey % 25 AS STRING) AS title, 'pay ' || o_orderpriority AS description,
       {add_days:DATE '2001-08-01', CAST(o_orderkey % 40 AS INT) - 30} AS due_date, o_orderkey % 4 = 0 AS is_completed, CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS priority
FROM {orders} WHERE o_orderkey % 10 = 3""",
    "snapshots": """
SELECT CAST(floor(o_custkey / 75) AS BIGINT) AS user_id, CAST(o_orderdate AS DATE) AS snapshot_date, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS DECIMAL(19,2)) AS assets_total,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END) AS DECIMAL(19,2)) AS liabilities_total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(19,2)) ELSE -CAST(o_totalprice AS DECIMAL(19,2)) END) AS DECIMAL(19,2)) AS net_worth
FROM {orders} GROUP BY 1, 2""",
    "preferences": """
SELECT DISTINCT CAST(floor(c_custkey / 75) AS BIGINT) AS user_id, CASE CAST(floor(c_custkey / 75) AS BIGINT) % 3 WHEN 0 THEN NULL WHEN 1 THEN 'inc-75-150k' ELSE 'inc-0-75k' END AS income_tier,
       CAST(CAST(floor(c_custkey / 75) AS BIGINT) % 2 + 1 AS INT) AS household_size, CAST(floor(c_custkey / 75) AS BIGINT) % 5 <> 0 AS anonymised_stats_opt_in,
       CASE CAST(floor(c_custkey / 75) AS BIGINT) % 3 WHEN 0 THEN 'LOOSE' WHEN 1 THEN 'NORMAL' ELSE 'STRICT' END AS anomaly_sensitivity
FROM {customer}""",
    "feedback": """
SELECT CAST(floor(o_custkey / 75) AS BIGINT) AS user_id, CAST(o_orderkey AS STRING) AS transaction_id, CASE WHEN o_orderkey % 2 = 0 THEN 'DISMISSED' ELSE 'CONFIRMED' END AS verdict FROM {orders} WHERE o_orderkey % 6 < 2""",
    "imports": """
SELECT 'i' || CAST(o_orderkey AS STRING) AS import_id, CAST(floor(o_custkey / 75) AS BIGINT) AS user_id, CASE o_orderstatus WHEN 'O' THEN 'COMPLETED' WHEN 'F' THEN 'FAILED' ELSE 'PARTIAL' END AS status,
       CAST(o_orderkey % 100 AS INT) AS successful, CAST(o_orderkey % 7 AS INT) AS failed, CAST(o_orderkey % 5 AS INT) AS duplicates FROM {orders} WHERE o_orderkey % 8 = 0""",
}


def _months(m: re.Match, spark: bool) -> str:
    kind, day, n = m[1], m[2], m[3]
    if spark:
        return f"add_months({day}, {n})" if kind == "add_months" else f"date_add({day}, {n})"
    return f"CAST({day} + to_months(CAST({n} AS INT)) AS DATE)" if kind == "add_months" else f"({day} + ({n}))"


def _fill(sql: str, spark: bool) -> str:
    return re.sub(r"\{(add_months|add_days):([^,]+), ([^{}]+)\}", lambda m: _months(m, spark), sql)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical frame over the Parquet tables in sf_dir."""
    sql = _fill(FRAMES[name], True)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def ctes(*names: str) -> str:
    """The same frames as the beginning of a DuckDB query: WITH RECURSIVE tx AS (...), ..."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', _fill(FRAMES[n], False))})" for n in names)
