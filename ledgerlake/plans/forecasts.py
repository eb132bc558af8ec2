"""Registered queries of operators.forecasts."""

from ledgerlake.adapter import AS_OF
from ledgerlake.operators import aggregates as A
from ledgerlake.operators import forecasts as P
from ledgerlake.registry import register

_D = "DATE '2001-08-01'"
_IOS = "('income', 'salary', 'investment', 'savings', 'interest')"
_MEDIANS = f"""ms AS (SELECT user_id, date_trunc('month', transaction_date) AS month, CAST(sum(amount) FILTER (amount > 0 AND (coalesce(lower(category_primary), '') IN {_IOS} OR coalesce(lower(category_detailed), '') IN {_IOS})) * 100 AS BIGINT) AS income, CAST(sum(-amount) FILTER (amount < 0) * 100 AS BIGINT) AS expense FROM tx WHERE NOT deleted AND transaction_date BETWEEN DATE '2001-02-01' AND {_D} GROUP BY 1, 2),
md AS (SELECT user_id, CAST(coalesce(round(quantile_cont(income, 0.5)) / 100, 0) AS DECIMAL(19,2)) AS median_income, CAST(coalesce(round(quantile_cont(expense, 0.5)) / 100, 0) AS DECIMAL(19,2)) AS median_expense FROM ms GROUP BY 1)"""


@register("x01_cash_flow", "user_id l, liquid m, net m, runway l, cash_30 m, cash_60 m, cash_90 m, status s", "tx accounts", f"""WITH {_MEDIANS},
li AS (SELECT user_id, sum(balance) AS liquid FROM accounts WHERE active AND lower(account_type) IN ('checking', 'savings') GROUP BY 1), j AS (SELECT user_id, coalesce(liquid, 0) AS liquid, median_income - median_expense AS net FROM md LEFT JOIN li USING (user_id)),
r AS (SELECT *, CASE WHEN net >= 0 THEN 365 ELSE greatest(0, least(365, floor(CAST(liquid AS DOUBLE) / CAST(-net AS DOUBLE) * 30.4375::DOUBLE))) END AS runway FROM j)
SELECT *, liquid + net AS cash_30, liquid + 2 * net AS cash_60, liquid + 3 * net AS cash_90, CASE WHEN net >= 0 THEN 'SURPLUS' WHEN runway < 30 THEN 'CRITICAL' WHEN runway < 60 THEN 'LOW' WHEN runway < 90 THEN 'TIGHT' ELSE 'HEALTHY' END AS status FROM r""")
def _(tx, accounts):
    return P.cash_flow(tx, accounts, AS_OF)


def _regression(name: str, rows: str, keys: str, value: str) -> str:
    return f"""{name}x AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY transaction_date, transaction_id) - 1 AS x, CAST({value} AS DOUBLE) AS y FROM tx WHERE {rows}),
{name}g AS (SELECT {keys}, count(*) AS n, avg(y) AS mean, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, max(y) AS top FROM {name}x GROUP BY {keys}),
{name} AS (SELECT *, greatest(0, slope * n + mean - slope * (n - 1) / 2) AS following FROM {name}g)"""


_SPENDING = f"amount < 0 AND category_primary IS NOT NULL AND transaction_date BETWEEN DATE '2001-02-01' AND {_D}"


@register("x03_predicted_anomalies", "user_id l, category_primary s, n l, kind s, following f, fence f", "tx", f"""WITH {_regression('c', _SPENDING, 'user_id, category_primary', 'abs(amount)')},
k AS (SELECT *, q3 + 1.5 * (q3 - q1) AS fe, CASE WHEN slope > 0 AND r2 > 0.5 AND following > 2 * mean THEN 'TREND' WHEN top > q3 + 1.5 * (q3 - q1) THEN 'FENCE' END AS kind FROM c WHERE n >= 4) SELECT user_id, category_primary, n, kind, round(following, 2) AS following, round(fe, 2) AS fence FROM k WHERE kind IS NOT NULL""")
def _(tx):
    return P.predicted_anomalies(tx, AS_OF)


@register("x04_predicted_cuts", "user_id l, name s, kind s, value f", "tx", f"""WITH {_regression('m', _SPENDING + ' AND merchant_name IS NOT NULL', 'user_id, merchant_name', 'abs(amount)')}, {_regression('c', _SPENDING, 'user_id, category_primary', 'abs(amount)')}
SELECT user_id, merchant_name AS name, 'USAGE' AS kind, round(slope, 4) AS value FROM m WHERE n >= 3 AND slope < -0.1 UNION ALL SELECT user_id, category_primary, 'CATEGORY', round(following, 4) FROM c WHERE n >= 3 AND following > 1.2 * mean""")
def _(tx):
    return P.predicted_cuts(tx, AS_OF)


@register("x05_goal_probability", "goal_id s, user_id l, rate f, consistency f, probability f", "tx goals", f"""
WITH m AS (SELECT user_id, date_trunc('month', transaction_date) AS month, coalesce(sum(amount) FILTER (amount > 0), 0) AS income, coalesce(sum(-amount) FILTER (amount < 0), 0) AS expense FROM tx WHERE transaction_date BETWEEN DATE '2001-02-01' AND {_D} GROUP BY 1, 2),
r AS (SELECT user_id, CAST(income - expense AS DOUBLE) / CAST(income AS DOUBLE) AS rate FROM m WHERE income > 0), g AS (SELECT user_id, avg(rate) AS rate, stddev_pop(rate) AS sigma FROM r GROUP BY 1),
h AS (SELECT user_id, rate, CASE WHEN rate > 0 THEN greatest(0, 1 - sigma / rate) ELSE 0 END AS steady FROM g), p AS (SELECT *, least(0.95::DOUBLE, greatest(0, rate) * steady * 10) AS p FROM h)
SELECT goal_id, user_id, round(rate, 4) AS rate, round(steady, 4) AS consistency, round(CASE WHEN rate < 0.1 THEN p / 2 ELSE p END, 4) AS probability FROM goals JOIN p USING (user_id) WHERE NOT completed""")
def _(tx, goals):
    return P.goal_probability(tx, goals, AS_OF)


@register("x06_payment_risk", "user_id l, merchant_name s, n l, consistency f, expected d", "tx", f"""
WITH g AS (SELECT *, transaction_date - lag(transaction_date) OVER (PARTITION BY user_id, merchant_name ORDER BY transaction_date, transaction_id) AS gap FROM tx WHERE amount < 0 AND merchant_name IS NOT NULL AND transaction_date BETWEEN DATE '2001-02-01' AND {_D}),
s AS (SELECT user_id, merchant_name, count(*) AS n, avg(gap) AS mean, stddev_pop(gap) AS sigma, max(transaction_date) AS last FROM g GROUP BY 1, 2), c AS (SELECT user_id, merchant_name, n, round(greatest(0, 1 - sigma / mean), 4) AS consistency, last + CAST(floor(mean) AS INT) AS expected FROM s WHERE n >= 3 AND mean > 0)
SELECT * FROM c WHERE consistency < 0.7 AND expected - {_D} < 7""")
def _(tx):
    return P.payment_risk(tx, AS_OF)


@register("x07_interest_forecast", "account_id l, user_id l, n l, expected_balance f, annual_interest f", "tx accounts", """
WITH l AS (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, transaction_id DESC) <= 12), x AS (SELECT account_id, CAST(amount AS DOUBLE) AS y, row_number() OVER (PARTITION BY account_id ORDER BY transaction_date, transaction_id) - 1 AS x FROM l),
g AS (SELECT account_id, count(*) AS n, CASE WHEN count(*) > 1 THEN regr_slope(y, x) ELSE 0 END AS slope FROM x GROUP BY 1)
SELECT account_id, user_id, n, round(greatest(0, CAST(abs(balance) AS DOUBLE) - slope), 4) AS expected_balance, round(greatest(0, CAST(abs(balance) AS DOUBLE) - slope) * CAST(apr_percent AS DOUBLE) / 100, 6) AS annual_interest FROM accounts JOIN g USING (account_id) WHERE account_type = 'creditCard' AND apr_percent IS NOT NULL""")
def _(tx, accounts):
    return P.interest_forecast(tx, accounts)


@register("x08_discretionary", "user_id l, kind s, name s, saving m", "tx", f"""
WITH r AS (SELECT * FROM tx WHERE NOT coalesce(is_hidden, FALSE) AND amount < 0 AND transaction_date BETWEEN {_D} - 90 AND {_D}),
c AS (SELECT user_id, category_primary AS name, (CAST(sum(-amount) * 200 AS BIGINT) + 3) // 6 AS cents FROM r WHERE lower(category_primary) IN ('entertainment', 'dining', 'shopping', 'travel', 'hobbies') GROUP BY 1, 2),
m AS (SELECT user_id, merchant_name AS name, count(*) AS n, (CAST(sum(-amount) * 200 AS BIGINT) + count(*)) // (2 * count(*)) AS cents FROM r WHERE merchant_name IS NOT NULL GROUP BY 1, 2)
SELECT user_id, 'DISCRETIONARY' AS kind, name, (cents * 2 + 5) // 10 * 0.01 AS saving FROM c WHERE cents > 20000 UNION ALL SELECT user_id, 'RARE', name, cents * 0.01 FROM m WHERE n <= 2 AND cents > 5000""")
def _(tx):
    return P.discretionary(tx, AS_OF)


@register("g01_goal_projection", "goal_id s, user_id l, monthly m, missing m, months_needed l, months_left l, status s", "goals tx", f"""
WITH p AS (SELECT user_id, goal_id, (CAST(sum(amount) * 200 AS BIGINT) + 3) // 6 AS cents FROM tx WHERE amount > 0 AND goal_id IS NOT NULL AND transaction_date BETWEEN DATE '2001-05-01' AND {_D} GROUP BY 1, 2),
j AS (SELECT g.goal_id, g.user_id, coalesce(cents, 0) * 0.01 AS monthly, greatest(0, target_amount - current_amount) AS missing, completed, CASE WHEN coalesce(cents, 0) > 0 THEN (CAST(greatest(0, target_amount - current_amount) * 100 AS BIGINT) + cents - 1) // cents END AS months_needed,
  (year(target_date) - 2001) * 12 + month(target_date) - 8 AS months_left FROM goals g LEFT JOIN p ON p.user_id = g.user_id AND p.goal_id = g.goal_id)
SELECT *, CASE WHEN completed OR missing = 0 THEN 'COMPLETED' WHEN monthly = 0 THEN 'NO_CONTRIBUTIONS' WHEN months_needed > months_left THEN 'BEHIND' WHEN months_needed < months_left - 1 THEN 'AHEAD' ELSE 'ON_TRACK' END AS status FROM j""")
def _(goals, tx):
    return P.goal_projection(goals, tx, AS_OF)


_PROGRESS = """p AS (SELECT user_id, goal_id, sum(amount) AS paid FROM tx WHERE amount > 0 AND goal_id IS NOT NULL GROUP BY 1, 2),
j AS (SELECT g.user_id, g.goal_id, target_amount, completed, last_milestone, CAST(least(coalesce(paid, 0) + coalesce(balance, 0), target_amount) AS DECIMAL(19,2)) AS progress FROM goals g LEFT JOIN p ON p.user_id = g.user_id AND p.goal_id = g.goal_id LEFT JOIN accounts a ON a.account_id = linked_account_id AND a.balance > 0),
pr AS (SELECT *, least(round(CAST(round(progress / target_amount, 4) AS DECIMAL(19,4)) * 100, 0), 100) AS percent FROM j)"""


@register("g02_milestones", "goal_id s, user_id l, milestone l, reached b, amount m", "goals tx accounts", f"WITH {_PROGRESS} SELECT goal_id, user_id, milestone, percent >= milestone AS reached, target_amount * milestone / 100 AS amount FROM pr CROSS JOIN (VALUES (25), (50), (75), (100)) m(milestone)")
def _(goals, tx, accounts):
    return P.milestones(A.goal_progress(goals, tx, accounts))


@register("g05_crossed_milestones", "goal_id s, user_id l, percent l, milestone l", "goals tx accounts", f"WITH {_PROGRESS}, c AS (SELECT *, CASE WHEN percent >= 100 THEN 100 WHEN percent >= 75 THEN 75 WHEN percent >= 50 THEN 50 WHEN percent >= 25 THEN 25 ELSE 0 END AS milestone FROM pr WHERE NOT completed) SELECT goal_id, user_id, percent, milestone FROM c WHERE milestone > last_milestone")
def _(goals, tx, accounts):
    return P.crossed_milestones(A.goal_progress(goals, tx, accounts), goals)


@register("x11_planner", "user_id l, liquid m, safe m, verdict s, months_delayed l, share m", "tx accounts goals", f"""WITH {_MEDIANS},
li AS (SELECT user_id, sum(balance) AS liquid FROM accounts WHERE active AND regexp_matches(lower(account_type), 'checking|savings|money_market') GROUP BY 1), nd AS (SELECT user_id, sum(monthly_contribution) AS need FROM goals WHERE NOT completed GROUP BY 1),
j AS (SELECT user_id, liquid, coalesce(need, 0) AS need, greatest(0, liquid - median_expense - coalesce(need, 0)) AS safe FROM li JOIN md USING (user_id) LEFT JOIN nd USING (user_id))
SELECT user_id, liquid, safe, CASE WHEN safe >= 40000 THEN 'YES' WHEN liquid >= 40000 THEN 'WAIT' ELSE 'NO' END AS verdict, CASE WHEN need > 0 THEN ceil(greatest(40000 - safe, 0) / need) ELSE 0 END AS months_delayed, coalesce(round(40000 / nullif(liquid, 0), 4), 0) AS share FROM j""")
def _(tx, accounts, goals):
    return P.planner(tx, accounts, goals, AS_OF, 40000)


_HEALTH = """f AS (SELECT user_id, CAST(round(CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS DECIMAL(19,2)) / 3, 2) AS DECIMAL(19,2)) AS income, CAST(round(CAST(coalesce(sum(abs(amount)) FILTER (amount < 0 AND NOT coalesce(is_hidden, FALSE)), 0) AS DECIMAL(19,2)) / 3, 2) AS DECIMAL(19,2)) AS expense FROM tx WHERE transaction_date BETWEEN DATE '2001-05-01' AND DATE '2001-08-01' GROUP BY user_id),
a AS (SELECT user_id, coalesce(sum(balance) FILTER (lower(account_type) IN ('checking', 'savings') AND balance > 0), 0) AS liquid, coalesce(sum(-balance) FILTER (balance < 0), 0) AS debt FROM accounts GROUP BY user_id),
h AS (SELECT user_id, income, expense, CAST(coalesce(round((income - expense) / nullif(income, 0), 4), 0) AS DECIMAL(19,4)) AS sr, CAST(coalesce(round(coalesce(debt, 0) / nullif(income * 12, 0), 4), 0) AS DECIMAL(19,4)) AS dti, CAST(least(coalesce(round(coalesce(liquid, 0) / nullif(expense * 6, 0), 4), 0), 1) AS DECIMAL(19,4)) AS ep FROM f LEFT JOIN a USING (user_id))"""


@register("g04_recommendations", "user_id l, goal_type s, target m", "tx accounts goals", f"""
WITH {_HEALTH},
b AS (SELECT user_id, 'EMERGENCY_FUND' AS goal_type, CAST(expense * 6 AS DECIMAL(18,2)) * (1 - ep) AS target FROM h WHERE ep < 1 UNION ALL SELECT user_id, 'DEBT_PAYOFF', CAST(income * 12 AS DECIMAL(18,2)) * (dti - 0.36) FROM h WHERE dti > 0.36
  UNION ALL SELECT user_id, 'SAVINGS_RATE', income * (0.20 - sr) FROM h WHERE sr < 0.20 UNION ALL SELECT user_id, 'WANTS_BUDGET', income * 0.20 FROM h WHERE income - expense * 0.7 > 0 UNION ALL SELECT user_id, 'RETIREMENT', income * 12 * 0.15 FROM h WHERE income > 0)
SELECT user_id, goal_type, round(target, 2) AS target FROM b WHERE NOT EXISTS (SELECT 1 FROM goals g WHERE g.user_id = b.user_id AND g.goal_type = b.goal_type)""")
def _(tx, accounts, goals):
    return P.recommendations(tx, accounts, goals, AS_OF)


@register("g01_projection_bands", "goal_id s, user_id l, ema f, p50_months l, p90_months l, trend s", "goals tx", f"""
WITH r AS (SELECT user_id, goal_id, date_trunc('month', transaction_date) AS month, sum(amount) AS paid, min(transaction_date) AS first FROM tx WHERE amount > 0 AND goal_id IS NOT NULL AND transaction_date > CAST({_D} - to_months(36) AS DATE) AND transaction_date <= {_D} GROUP BY 1, 2, 3),
g AS (SELECT user_id, goal_id, list(CAST(paid AS DOUBLE) ORDER BY month) AS v, sum(paid) AS total, greatest(1, least(36, ({_D} - min(first) + 30) // 30)) AS span FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
e AS (SELECT *, list_reduce(v, lambda a, x: 0.5::DOUBLE * x + 0.5::DOUBLE * a) AS ema, list_reduce(list_prepend(0::DOUBLE, v), lambda a, x: a + x) / len(v) AS mean, CAST(round(CAST(total AS DECIMAL(19,2)) / span, 2) AS DOUBLE) AS average FROM g),
f AS (SELECT *, greatest(1::DOUBLE, ema - sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(v, lambda x: (x - mean) * (x - mean))), lambda a, x: a + x) / (len(v) - 1))) AS slow FROM e),
j AS (SELECT goal_id, user_id, ema, average, greatest(1, CAST(ceil(CAST(target_amount - current_amount AS DOUBLE) / ema) AS BIGINT)) AS p50_months, CAST(ceil(CAST(target_amount - current_amount AS DOUBLE) / slow) AS BIGINT) AS p90 FROM f JOIN goals USING (user_id, goal_id) WHERE target_amount > current_amount AND ema > 0)
SELECT goal_id, user_id, round(ema, 2) AS ema, p50_months, greatest(p50_months, p90) AS p90_months, CASE WHEN average <= 0 OR abs(ema - average) / greatest(1::DOUBLE, average) < 0.10 THEN 'STEADY' WHEN ema > average THEN 'ACCELERATING' ELSE 'DECELERATING' END AS trend FROM j""")
def _(goals, tx):
    return P.projection_bands(goals, tx, AS_OF, months=36)
