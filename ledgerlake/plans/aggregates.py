"""Registered queries of operators.aggregates."""

from pyspark.sql import functions as F

from ledgerlake.adapter import AS_OF
from ledgerlake.operators import aggregates as A
from ledgerlake.registry import register

YEAR = ("2000-08-01", AS_OF)
IN_YEAR = "transaction_date BETWEEN DATE '2000-08-01' AND DATE '2001-08-01'"


@register("a01_spending_summary", "user_id l, total m, n l", "tx", f"SELECT user_id, sum(amount) AS total, count(*) AS n FROM tx WHERE {IN_YEAR} GROUP BY user_id")
def _(tx):
    return A.spending_summary(tx, *YEAR)


@register("a03_spending_by_category", "user_id l, category s, total m", "tx", f"SELECT user_id, coalesce(category_primary, category_detailed) AS category, sum(amount) AS total FROM tx WHERE {IN_YEAR} AND coalesce(category_primary, category_detailed) IS NOT NULL GROUP BY 1, 2")
def _(tx):
    return A.spending_by_category(tx, *YEAR)


@register("a04_income_expense_report", "user_id l, income m, expense m, net m", "tx", f"""
SELECT user_id, coalesce(sum(amount) FILTER (amount > 0), 0) AS income, coalesce(sum(abs(amount)) FILTER (amount <= 0), 0) AS expense,
       coalesce(sum(amount) FILTER (amount > 0), 0) - coalesce(sum(abs(amount)) FILTER (amount <= 0), 0) AS net FROM tx WHERE NOT deleted AND {IN_YEAR} GROUP BY user_id""")
def _(tx):
    return A.income_expense_report(tx, *YEAR)


@register("a04_expense_by_category", "user_id l, category s, spent m", "tx", f"SELECT user_id, coalesce(category_primary, category_detailed, 'uncategorized') AS category, sum(abs(amount)) AS spent FROM tx WHERE NOT deleted AND amount <= 0 AND {IN_YEAR} GROUP BY 1, 2")
def _(tx):
    return A.expense_by_category(tx, *YEAR)


_MONTHS = """
WITH users AS (SELECT DISTINCT user_id FROM {of}), spine AS (SELECT user_id, CAST(DATE '2001-08-01' - to_months(k) AS DATE) AS month FROM users CROSS JOIN (SELECT unnest(range(12))::INT AS k)),
v AS ({value}) SELECT user_id, month, coalesce(value, 0) AS value FROM spine LEFT JOIN v USING (user_id, month)"""


@register("a05_monthly_spend", "user_id l, month d, value m", "tx", _MONTHS.format(of="tx WHERE NOT deleted", value="SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, sum(abs(amount)) AS value FROM tx WHERE NOT deleted AND amount < 0 GROUP BY 1, 2"))
def _(tx):
    return A.monthly_spend(tx, AS_OF)


@register("a06_monthly_saving", "user_id l, month d, value m", "tx", _MONTHS.format(of="tx WHERE NOT deleted", value="SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, sum(amount) AS value FROM tx WHERE NOT deleted GROUP BY 1, 2"))
def _(tx):
    return A.monthly_saving(tx, AS_OF)


@register("a07_monthly_net_worth", "user_id l, month d, value m", "snapshots", _MONTHS.format(of="snapshots", value="SELECT user_id, CAST(date_trunc('month', snapshot_date) AS DATE) AS month, arg_max(net_worth, snapshot_date) AS value FROM snapshots GROUP BY 1, 2"))
def _(snapshots):
    return A.monthly_net_worth(snapshots, AS_OF)


@register("a08_net_worth", "user_id l, assets m, liabilities m, net_worth m", "accounts", "SELECT user_id, coalesce(sum(balance) FILTER (balance >= 0), 0) AS assets, coalesce(sum(-balance) FILTER (balance < 0), 0) AS liabilities, sum(balance) AS net_worth FROM accounts GROUP BY user_id")
def _(accounts):
    return A.net_worth(accounts)


_WEEKS = """
WITH r AS (SELECT user_id, regexp_replace(lower(trim(merchant_name)), '[^a-z0-9]', '', 'g') AS merchant, CAST(date_trunc('week', transaction_date) AS DATE) AS week, amount FROM tx
           WHERE NOT deleted AND merchant_name IS NOT NULL AND transaction_date BETWEEN CAST(date_trunc('week', DATE '2001-08-01') AS DATE) - 175 AND DATE '2001-08-01'),
s AS (SELECT user_id, merchant, week, greatest(sum(-amount), 0) AS spent FROM r GROUP BY 1, 2, 3),
z AS (SELECT m.user_id, m.merchant, w.week, w.x, coalesce(spent, 0) AS spent FROM (SELECT DISTINCT user_id, merchant FROM s) m
      CROSS JOIN (SELECT CAST(date_trunc('week', DATE '2001-08-01') AS DATE) - 175 + 7 * k AS week, k AS x FROM (SELECT unnest(range(26))::INT AS k)) w LEFT JOIN s USING (user_id, merchant, week))"""


@register("a09_merchant_weekly_trend", "user_id l, merchant s, total m, average m, weeks_with_spend l, slope f, trend s", "tx", _WEEKS + """,
g AS (SELECT user_id, merchant, sum(spent) AS total, CAST((CAST(sum(spent) * 200 AS BIGINT) + 26) // 52 AS DOUBLE) / 100 AS average, count(*) FILTER (spent > 0) AS weeks_with_spend, round(regr_slope(CAST(spent AS DOUBLE), x), 4) AS slope FROM z GROUP BY 1, 2)
SELECT *, CASE WHEN abs(slope) / greatest(0.01, average) < 0.05 THEN 'FLAT' WHEN slope > 0 THEN 'RISING' ELSE 'FALLING' END AS trend FROM g""")
def _(tx):
    return A.merchant_weekly_trend(tx, AS_OF)


@register("a09_merchant_weeks", "user_id l, merchant s, week d, x l, spent m", "tx", _WEEKS + " SELECT user_id, merchant, week, x, spent FROM z")
def _(tx):
    return A.merchant_weeks(tx, AS_OF)


@register("a10_benchmark_percentiles", "bucket s, category s, p25 f, median f, p75 f, sample_size l", "tx preferences", """
WITH u AS (SELECT user_id, coalesce(income_tier, 'inc-75-150k') || '|' || CASE WHEN household_size <= 2 THEN '1-2' WHEN household_size <= 4 THEN '3-4' ELSE '5-plus' END AS bucket FROM preferences WHERE anonymised_stats_opt_in),
s AS (SELECT user_id, coalesce(category_primary, category_detailed) AS category, (CAST(sum(abs(amount)) * 200 AS BIGINT) + 3) // 6 AS cents FROM tx
      WHERE NOT deleted AND amount < 0 AND transaction_date BETWEEN DATE '2001-08-01' - 90 AND DATE '2001-08-01' AND coalesce(category_primary, category_detailed) IS NOT NULL GROUP BY 1, 2),
r AS (SELECT * FROM s JOIN u USING (user_id)), n AS (SELECT bucket FROM r GROUP BY bucket HAVING count(DISTINCT user_id) >= 4)
SELECT bucket, category, round(quantile_cont(CAST(cents AS DOUBLE), 0.25)) / 100 AS p25, round(quantile_cont(CAST(cents AS DOUBLE), 0.5)) / 100 AS median, round(quantile_cont(CAST(cents AS DOUBLE), 0.75)) / 100 AS p75, count(*) AS sample_size
FROM r WHERE bucket IN (SELECT bucket FROM n) GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(tx, preferences):
    return A.benchmark_percentiles(tx, preferences, AS_OF, least_users=4, least_category=2)  # the tables hold few users


_CROSS = "SELECT *, lower(trim(merchant_name)) AS merchant FROM tx WHERE NOT deleted AND amount < 0 AND account_id IS NOT NULL AND merchant_name IS NOT NULL AND transaction_date BETWEEN DATE '2001-08-01' - 400 AND DATE '2001-08-01'"


@register("a13_distinct_accounts_a_day", "user_id l, merchant s, transaction_date d, n_accounts l, n l, total m", "tx", f"SELECT user_id, merchant, transaction_date, count(DISTINCT account_id) AS n_accounts, count(*) AS n, sum(abs(amount)) AS total FROM ({_CROSS}) GROUP BY 1, 2, 3 HAVING count(DISTINCT account_id) >= 2")
def _(tx):
    return A.distinct_accounts_a_day(tx, AS_OF, days=400)


@register("a14_bursts", "user_id l, merchant s, transaction_date d, n l, total m", "tx", f"SELECT user_id, merchant, transaction_date, count(*) AS n, sum(abs(amount)) AS total FROM ({_CROSS}) GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def _(tx):
    return A.bursts(tx, AS_OF, days=400, least=2)


@register("a15_median_monthly", "user_id l, median_income m, median_expense m", "tx", """
WITH s AS (SELECT user_id, date_trunc('month', transaction_date) AS month,
  CAST(sum(amount) FILTER (amount > 0 AND (lower(category_primary) IN ('income', 'salary', 'investment', 'savings', 'interest') OR coalesce(lower(category_detailed), '') IN ('income', 'salary', 'investment', 'savings', 'interest'))) * 100 AS BIGINT) AS income,
  CAST(sum(-amount) FILTER (amount < 0) * 100 AS BIGINT) AS expense FROM tx WHERE NOT deleted AND transaction_date BETWEEN DATE '2001-02-01' AND DATE '2001-08-01' GROUP BY 1, 2)
SELECT user_id, coalesce(round(quantile_cont(income, 0.5)) / 100, 0) AS median_income, coalesce(round(quantile_cont(expense, 0.5)) / 100, 0) AS median_expense FROM s GROUP BY user_id""")
def _(tx):
    return A.median_monthly_income_expense(tx, AS_OF)


@register("a16_display_names", "user_id l, merchant s, name s, weight l", "tx subscriptions", """
WITH n AS (SELECT user_id, merchant_name AS name, 1 AS w FROM tx WHERE merchant_name IS NOT NULL UNION ALL SELECT user_id, merchant_name, 5 FROM subscriptions WHERE active),
s AS (SELECT user_id, regexp_replace(lower(trim(name)), '[^a-z0-9]', '', 'g') AS merchant, name, sum(w) AS weight FROM n GROUP BY 1, 2, 3)
SELECT user_id, merchant, name, weight FROM s QUALIFY row_number() OVER (PARTITION BY user_id, merchant ORDER BY weight DESC, name) = 1""")
def _(tx, subscriptions):
    return A.display_names(tx, subscriptions)


@register("a17_import_statistics", "user_id l, n_imports l, completed l, failed l, partial l, successful_rows l, failed_rows l, duplicates_rows l", "imports", "SELECT user_id, count(*) AS n_imports, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PARTIAL') AS partial, sum(successful) AS successful_rows, sum(failed) AS failed_rows, sum(duplicates) AS duplicates_rows FROM imports GROUP BY user_id")
def _(imports):
    return A.import_statistics(imports)


@register("a20_contribution_insights", "user_id l, goal_id s, total m, n l, largest m, top_source s, average m", "tx", """
WITH r AS (SELECT *, CASE WHEN round_up_source_transaction_id IS NOT NULL THEN 'ROUND_UP' WHEN lower(category_primary) IN ('income', 'salary', 'investment', 'savings', 'interest') THEN 'INCOME' WHEN lower(description) LIKE '%transfer%' THEN 'RECURRING_TRANSFER' ELSE 'MANUAL' END AS source FROM tx WHERE amount > 0 AND goal_id IS NOT NULL),
s AS (SELECT user_id, goal_id, source, sum(amount) AS part, count(*) AS k, max(amount) AS top FROM r GROUP BY 1, 2, 3)
SELECT user_id, goal_id, sum(part) AS total, sum(k) AS n, max(top) AS largest, arg_max(source, (part, source)) AS top_source, CAST((CAST(sum(part) * 200 AS BIGINT) + sum(k)) // (2 * sum(k)) AS DOUBLE) / 100 AS average FROM s GROUP BY 1, 2""")
def _(tx):
    return A.contribution_insights(tx)


@register("a21_goal_progress", "user_id l, goal_id s, target_amount m, progress m, percent l", "goals tx accounts", """
WITH p AS (SELECT user_id, goal_id, sum(amount) AS paid FROM tx WHERE amount > 0 AND goal_id IS NOT NULL GROUP BY 1, 2),
j AS (SELECT g.user_id, g.goal_id, target_amount, CAST(least(coalesce(paid, 0) + coalesce(balance, 0), target_amount) AS DECIMAL(19,2)) AS progress FROM goals g LEFT JOIN p ON p.user_id = g.user_id AND p.goal_id = g.goal_id LEFT JOIN accounts a ON a.account_id = linked_account_id AND a.balance > 0)
SELECT *, least(round(CAST(round(progress / target_amount, 4) AS DECIMAL(19,4)) * 100, 0), 100) AS percent FROM j""")
def _(goals, tx, accounts):
    return A.goal_progress(goals, tx, accounts)


@register("j04_linked_accounts", "user_id l, goal_id s, target_amount m, progress m, percent l", "goals tx accounts", """
WITH p AS (SELECT user_id, goal_id, sum(amount) AS paid FROM tx WHERE amount > 0 AND goal_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT goal_id, sum(balance) AS balance FROM (SELECT goal_id, unnest([linked_account_id, linked_account_id + 2]) AS account_id FROM goals) JOIN accounts USING (account_id) WHERE balance > 0 GROUP BY 1),
j AS (SELECT g.user_id, g.goal_id, target_amount, CAST(least(coalesce(paid, 0) + coalesce(balance, 0), target_amount) AS DECIMAL(19,2)) AS progress FROM goals g LEFT JOIN p ON p.user_id = g.user_id AND p.goal_id = g.goal_id LEFT JOIN l ON l.goal_id = g.goal_id)
SELECT *, least(round(CAST(round(progress / target_amount, 4) AS DECIMAL(19,4)) * 100, 0), 100) AS percent FROM j""")
def _(goals, tx, accounts):
    linked = F.array("linked_account_id", F.col("linked_account_id") + 2, "linked_account_id")
    return A.goal_progress(goals.withColumn("linked_account_ids", linked).drop("linked_account_id"), tx, accounts)


@register("a22_round_up_total", "user_id l, total m, n l", "tx", "SELECT user_id, sum(abs(amount)) AS total, count(*) AS n FROM tx WHERE NOT deleted AND round_up_source_transaction_id IS NOT NULL AND transaction_date BETWEEN DATE '2001-08-01' - 300 AND DATE '2001-08-01' GROUP BY user_id")
def _(tx):
    return A.round_up_total(tx, AS_OF, days=300)


@register("g03_round_up_contributions", "user_id l, goal_id s, source_transaction_id s, round_up m, round_up_id s", "tx goals", """
SELECT t.user_id, t.goal_id, transaction_id AS source_transaction_id, ceil(abs(amount)) - abs(amount) AS round_up, md5('roundup|' || transaction_id) AS round_up_id FROM tx t JOIN goals g ON g.user_id = t.user_id AND g.goal_id = t.goal_id
WHERE amount < 0 AND round_up_source_transaction_id IS NULL AND round_up_enabled AND NOT completed AND ceil(abs(amount)) > abs(amount)""")
def _(tx, goals):
    return A.round_up_contributions(tx, goals)


@register("a11_category_density", "user_id l, category s, n l, monthly m", "subscriptions", """
SELECT user_id, category, count(*) AS n, sum(round(CAST(CAST(amount AS DOUBLE) * CAST(CASE frequency WHEN 'DAILY' THEN 30.0 WHEN 'WEEKLY' THEN 4.333 WHEN 'BI_WEEKLY' THEN 2.167 WHEN 'MONTHLY' THEN 1.0 WHEN 'QUARTERLY' THEN 1.0::DOUBLE / 3 WHEN 'SEMI_ANNUAL' THEN 1.0::DOUBLE / 6 ELSE 1.0::DOUBLE / 12 END AS DOUBLE) AS DECIMAL(19,6)), 2)) AS monthly
FROM subscriptions WHERE active GROUP BY 1, 2""")
def _(subscriptions):
    return A.category_density(subscriptions)


_CYCLE = {
    "begins": "CASE lower(period) WHEN 'weekly' THEN CAST(date_trunc('week', DATE '2001-08-01') AS DATE) WHEN 'biweekly' THEN DATE '2024-01-01' + CAST(trunc((DATE '2001-08-01' - DATE '2024-01-01') / 14.0) AS INT) * 14 ELSE DATE '2001-08-01' END",
    "ends": "CASE lower(period) WHEN 'weekly' THEN CAST(date_trunc('week', DATE '2001-08-01') AS DATE) + 6 WHEN 'biweekly' THEN DATE '2024-01-01' + CAST(trunc((DATE '2001-08-01' - DATE '2024-01-01') / 14.0) AS INT) * 14 + 13 ELSE DATE '2001-08-31' END",
}


@register("a23_weekly_digest", "user_id l, spent m, income m, over_budget l, goals_on_track l", "tx budgets goals", f"""
WITH w AS (SELECT user_id, coalesce(sum(abs(amount)) FILTER (amount < 0), 0) AS spent, coalesce(sum(amount) FILTER (amount > 0), 0) AS income FROM tx WHERE NOT deleted AND transaction_date BETWEEN DATE '2001-08-01' - 7 AND DATE '2001-08-01' GROUP BY user_id),
b AS (SELECT *, {_CYCLE["begins"]} AS begins, {_CYCLE["ends"]} AS ends FROM budgets),
s AS (SELECT budget_id, b.user_id, any_value(monthly_limit) AS lim, any_value(ends - begins + 1) AS days, any_value(greatest(1, least(ends - begins + 1, DATE '2001-08-01' - begins + 1))) AS gone, coalesce(sum(-amount) FILTER (amount < 0), 0) AS spend
  FROM b LEFT JOIN tx t ON t.user_id = b.user_id AND NOT t.deleted AND t.transaction_date BETWEEN begins AND least(ends, DATE '2001-08-01') AND (t.category_primary = b.category OR t.category_detailed = b.category) AND NOT coalesce(t.pending, FALSE)
    AND (trim(coalesce(t.currency_code, '')) = '' OR trim(coalesce(b.currency_code, '')) = '' OR lower(trim(t.currency_code)) = lower(trim(b.currency_code))) GROUP BY 1, 2),
o AS (SELECT user_id, count(*) FILTER (spend * 10000 > lim * ((20000 * gone + days) // (2 * days))) AS over_budget FROM s GROUP BY 1), g AS (SELECT user_id, count(*) AS goals_on_track FROM goals WHERE NOT completed AND current_amount * 4 > target_amount GROUP BY 1)
SELECT user_id, coalesce(spent, 0) AS spent, coalesce(income, 0) AS income, coalesce(over_budget, 0) AS over_budget, coalesce(goals_on_track, 0) AS goals_on_track FROM w FULL JOIN o USING (user_id) FULL JOIN g USING (user_id)""")
def _(tx, budgets, goals):
    return A.weekly_digest(tx, budgets, goals, AS_OF)


@register("a25_financial_health", "user_id l, income m, expense m, savings_rate m, debt_to_income m, emergency_progress m", "tx accounts", """
WITH f AS (SELECT user_id, CAST(round(CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS DECIMAL(19,2)) / 3, 2) AS DECIMAL(19,2)) AS income, CAST(round(CAST(coalesce(sum(abs(amount)) FILTER (amount < 0 AND NOT coalesce(is_hidden, FALSE)), 0) AS DECIMAL(19,2)) / 3, 2) AS DECIMAL(19,2)) AS expense FROM tx WHERE transaction_date BETWEEN DATE '2001-05-01' AND DATE '2001-08-01' GROUP BY user_id),
a AS (SELECT user_id, coalesce(sum(balance) FILTER (lower(account_type) IN ('checking', 'savings') AND balance > 0), 0) AS liquid, coalesce(sum(-balance) FILTER (balance < 0), 0) AS debt FROM accounts GROUP BY user_id)
SELECT user_id, income, expense, coalesce(round((income - expense) / nullif(income, 0), 4), 0) AS savings_rate, coalesce(round(coalesce(debt, 0) / nullif(income * 12, 0), 4), 0) AS debt_to_income, least(coalesce(round(coalesce(liquid, 0) / nullif(expense * 6, 0), 4), 0), 1) AS emergency_progress FROM f LEFT JOIN a USING (user_id)""")
def _(tx, accounts):
    return A.financial_health(tx, accounts, AS_OF)
