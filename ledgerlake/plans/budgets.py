"""Registered queries of operators.budgets."""

from ledgerlake.adapter import AS_OF
from ledgerlake.operators import aggregates as A
from ledgerlake.operators import budgets as B
from ledgerlake.registry import register

_D = "DATE '2001-08-01'"
_IOS = "('income', 'salary', 'investment', 'savings', 'interest')"


def _cycles(start: str, end: str, where: str, gate: bool = True, amount: str = "greatest(coalesce(sum(-amount), 0), 0)", only: str = "TRUE", also: str = "TRUE") -> str:
    gated = "NOT t.pending AND (trim(coalesce(b.currency_code, '')) = '' OR trim(coalesce(t.currency_code, '')) = '' OR lower(b.currency_code) = lower(t.currency_code))" if gate else "TRUE"
    return f"""c AS (SELECT *, {start} AS cycle_start, {end} AS cycle_end FROM budgets WHERE {only}),
spent AS (SELECT b.budget_id, CAST({amount} AS DECIMAL(19,2)) AS spent FROM c b LEFT JOIN tx t ON t.user_id = b.user_id AND (t.category_primary = b.category OR t.category_detailed = b.category)
  AND t.transaction_date BETWEEN b.cycle_start AND b.cycle_end AND {where} AND {gated} AND {also} GROUP BY b.budget_id)"""


_START = f"CASE period WHEN 'weekly' THEN CAST(date_trunc('week', {_D}) AS DATE) WHEN 'biweekly' THEN DATE '2024-01-01' + CAST(trunc(({_D} - DATE '2024-01-01') / 14.0) * 14 AS INT) ELSE DATE '2001-08-01' END"
_END = f"CASE period WHEN 'weekly' THEN CAST(date_trunc('week', {_D}) AS DATE) + 6 WHEN 'biweekly' THEN DATE '2024-01-01' + CAST(trunc(({_D} - DATE '2024-01-01') / 14.0) * 14 AS INT) + 13 ELSE DATE '2001-08-31' END"
_SUMMARY = f"""WITH {_cycles(_START, _END, 'NOT t.deleted')},
f AS (SELECT c.*, spent, monthly_limit + CASE WHEN rollover_enabled THEN carried_amount ELSE 0 END AS effective_limit, cycle_end - cycle_start + 1 AS days, {_D} - cycle_start + 1 AS gone FROM c JOIN spent USING (budget_id)),
g AS (SELECT *, effective_limit - spent AS remaining, CAST((CAST(spent * 200 AS BIGINT) + gone) // (2 * gone) * 0.01 AS DECIMAL(19,2)) AS burn_rate FROM f),
summary AS (SELECT *, burn_rate * days AS projected, CASE WHEN remaining > 0 AND days > gone THEN CAST((CAST(remaining * 200 AS BIGINT) + days - gone) // (2 * (days - gone)) * 0.01 AS DECIMAL(19,2)) ELSE 0 END AS daily_allowance, coalesce(round(spent / nullif(effective_limit, 0), 4), 0) AS used FROM g)"""


@register("b01_budget_summary", "budget_id s, user_id l, category s, cycle_start d, cycle_end d, spent m, effective_limit m, remaining m, burn_rate m, projected m, daily_allowance m, used m", "budgets tx", _SUMMARY + " SELECT * FROM summary")
def _(budgets, tx):
    return B.budget_summary(budgets, tx, AS_OF)


@register("b02_overrun_forecast", "budget_id s, forecast m, share m, severity s", "budgets tx", _SUMMARY + """,
h AS (SELECT b.budget_id, date_trunc('month', t.transaction_date) AS month, CAST(greatest(sum(-amount), 0) * 100 AS BIGINT) AS net FROM budgets b JOIN tx t ON t.user_id = b.user_id AND (t.category_primary = b.category OR t.category_detailed = b.category) AND NOT t.deleted AND t.transaction_date BETWEEN DATE '2001-05-01' AND DATE '2001-07-31' GROUP BY 1, 2),
u AS (SELECT budget_id, CAST(round(quantile_cont(net, 0.5)) / 100 AS DECIMAL(19,2)) AS usual FROM h GROUP BY 1),
o AS (SELECT budget_id, CAST(greatest(projected, coalesce(usual, 0)) AS DECIMAL(19,2)) AS forecast, effective_limit FROM summary LEFT JOIN u USING (budget_id)),
q AS (SELECT budget_id, forecast, (CAST(forecast * 2000000 AS BIGINT) + CAST(effective_limit * 100 AS BIGINT)) // CAST(effective_limit * 200 AS BIGINT) * 0.0001 AS share FROM o)
SELECT budget_id, forecast, share, CASE WHEN share >= 1.10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM q WHERE share >= 0.95""")
def _(budgets, tx):
    return B.overrun_forecast(budgets, tx, AS_OF)


@register("b03_exhaustion", "user_id l, budget_id s, days_left l, remaining m, severity s, place l", "budgets tx", _SUMMARY + f""",
e AS (SELECT *, CASE WHEN remaining <= 0 THEN 0 WHEN burn_rate > 0 THEN CAST(remaining * 100 AS BIGINT) // CAST(burn_rate * 100 AS BIGINT) END AS days_left FROM summary WHERE lower(category) NOT IN {_IOS}),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days_left, budget_id) AS place FROM e WHERE days_left IS NOT NULL AND (remaining <= 0 OR days_left < cycle_end - {_D}))
SELECT user_id, budget_id, days_left, remaining, CASE WHEN remaining <= 0 THEN 'EXHAUSTED' WHEN days_left <= 1 THEN 'CRITICAL' WHEN days_left <= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, place FROM p WHERE place <= 5""")
def _(budgets, tx):
    return B.exhaustion(budgets, tx, AS_OF)


@register("b04_rollover", "budget_id s, user_id l, spent m, carry m", "budgets tx", f"WITH {_cycles('DATE ' + chr(39) + '2001-07-01' + chr(39), 'DATE ' + chr(39) + '2001-07-31' + chr(39), 'TRUE', amount='coalesce(sum(-amount) FILTER (amount < 0), 0)', only=f'rollover_enabled AND lower(category) NOT IN {_IOS}')} SELECT budget_id, user_id, spent, monthly_limit + carried_amount - spent AS carry FROM c JOIN spent USING (budget_id)")
def _(budgets, tx):
    return B.rollover(budgets, tx, AS_OF)


@register("b05_threshold_crossings", "budget_id s, percent m, reached l, alert b, bookmark l", "budgets tx", f"""WITH {_cycles(_START, _END, 'TRUE')},
p AS (SELECT budget_id, last_alerted_threshold AS last, coalesce(round(spent / nullif(monthly_limit + carried_amount, 0), 4), 0) * 100 AS percent FROM c JOIN spent USING (budget_id)),
r AS (SELECT *, CASE WHEN percent >= 100 THEN 100 WHEN percent >= 90 THEN 90 WHEN percent >= 75 THEN 75 WHEN percent >= 50 THEN 50 ELSE 0 END AS reached, CASE last WHEN 100 THEN 90 WHEN 90 THEN 75 WHEN 75 THEN 50 ELSE 0 END AS below FROM p)
SELECT budget_id, round(percent, 2) AS percent, reached, reached > last AS alert, CASE WHEN reached > last THEN reached WHEN percent < below THEN reached ELSE last END AS bookmark FROM r""")
def _(budgets, tx):
    return B.threshold_crossings(budgets, tx, AS_OF)


_SUGGEST = f"""WITH n AS (SELECT user_id, category_primary AS category, date_trunc('month', transaction_date) AS month, CAST(greatest(sum(-amount), 0) * 100 AS BIGINT) AS net FROM tx
  WHERE NOT deleted AND transaction_date BETWEEN DATE '2001-02-01' AND {_D} AND category_primary IS NOT NULL AND lower(category_primary) NOT IN {_IOS} GROUP BY 1, 2, 3),
s AS (SELECT user_id, category, CAST(round(quantile_cont(net, 0.5)) / 100 AS DECIMAL(19,2)) AS median, count(*) AS months_observed FROM n GROUP BY 1, 2)
SELECT user_id, category, median, months_observed, ceil(CAST(median * 11000 AS BIGINT) / 50000.0) * 5 AS recommended FROM s WHERE months_observed >= 2 AND median > 0"""


@register("b06_suggestions", "user_id l, category s, median m, months_observed l, recommended m", "tx", _SUGGEST)
def _(tx):
    return B.suggestions(tx, AS_OF)


@register("b07_allocation_status", "user_id l, allocated m, income m, gap m, status s", "budgets tx", f"""
WITH i AS (SELECT user_id, round(quantile_cont(income, 0.5)) / 100 AS median_income FROM (SELECT user_id, date_trunc('month', transaction_date) AS month, CAST(sum(amount) FILTER (amount > 0 AND (lower(category_primary) IN {_IOS} OR coalesce(lower(category_detailed), '') IN {_IOS})) * 100 AS BIGINT) AS income FROM tx WHERE NOT deleted AND transaction_date BETWEEN DATE '2001-02-01' AND {_D} GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT user_id, sum(CASE period WHEN 'weekly' THEN round(monthly_limit * 30.4375 / 7, 2) WHEN 'biweekly' THEN round(monthly_limit * 30.4375 / 14, 2) ELSE monthly_limit END) AS allocated FROM budgets WHERE lower(category) NOT IN {_IOS} GROUP BY 1),
j AS (SELECT user_id, round(allocated, 2) AS allocated, coalesce(median_income, 0) AS income, round(coalesce(median_income, 0) - allocated, 2) AS gap FROM a LEFT JOIN i USING (user_id))
SELECT *, CASE WHEN abs(gap) <= 1 THEN 'BALANCED' WHEN gap > 0 THEN 'UNDER' ELSE 'OVER' END AS status FROM j""")
def _(budgets, tx):
    return B.allocation_status(budgets, A.median_monthly_income_expense(tx, AS_OF))


@register("b08_goal_flow", "budget_id s, goal_id s, spent m, fund m", "budgets tx", f"WITH {_cycles(_START, _END, 'NOT t.deleted', amount='coalesce(sum(-amount) FILTER (amount < 0), 0)', only='goal_id IS NOT NULL AND goal_allocation > 0')}, g AS (SELECT budget_id, c.goal_id, spent, greatest(least(greatest(monthly_limit - spent, 0), goal_allocation) - last_goal_funded, 0) AS fund FROM c JOIN spent USING (budget_id)) SELECT * FROM g WHERE fund > 0")
def _(budgets, tx):
    return B.goal_flow(budgets, tx, AS_OF)


@register("b09_seed_subscriptions_budget", "user_id l, monthly m, budget_limit m", "subscriptions budgets", """
WITH m AS (SELECT user_id, sum(round(CAST(CAST(amount AS DOUBLE) * CASE frequency WHEN 'DAILY' THEN 30::DOUBLE WHEN 'WEEKLY' THEN 4.33::DOUBLE WHEN 'BI_WEEKLY' THEN 2.17::DOUBLE WHEN 'MONTHLY' THEN 1::DOUBLE WHEN 'QUARTERLY' THEN 1::DOUBLE / 3 WHEN 'SEMI_ANNUAL' THEN 1::DOUBLE / 6 ELSE 1::DOUBLE / 12 END AS DECIMAL(19,6)), 2)) AS monthly FROM subscriptions WHERE active GROUP BY 1)
SELECT user_id, monthly, ceil(CAST(monthly * 11000 AS BIGINT) / 10000.0) AS budget_limit FROM m WHERE user_id NOT IN (SELECT user_id FROM budgets WHERE lower(category) = 'subscriptions')""")
def _(subscriptions, budgets):
    return B.seed_subscriptions_budget(subscriptions, budgets)
