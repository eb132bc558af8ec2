"""Registered queries of operators.recurrence."""

from ledgerlake.adapter import AS_OF
from ledgerlake.operators import recurrence as R
from ledgerlake.plans.anomalies import _D, _MERCHANT
from ledgerlake.registry import register

_CATEGORY_PARTS = "transfer|transfers|account transfer|internal transfer|bank transfer|credit card payment|cc payment|card payment|loan payment|investment transfer|brokerage transfer"
_TEXT_PARTS = "transfer from|transfer to|xfer from|xfer to|zelle|venmo cashout|venmo to bank|ach transfer|ach pull|ach push|internal transfer|payment to credit card|credit card payment|auto pay credit|wire transfer"
_IMPORTER_DETAILS = "'LOAN_PAYMENTS_CREDIT_CARD_PAYMENT', 'LOAN_PAYMENTS_CAR_PAYMENT', 'LOAN_PAYMENTS_MORTGAGE_PAYMENT', 'LOAN_PAYMENTS_PERSONAL_LOAN_PAYMENT', 'LOAN_PAYMENTS_STUDENT_LOAN_PAYMENT', 'LOAN_PAYMENTS_OTHER_PAYMENT', 'TRANSFER_IN_ACCOUNT_TRANSFER', 'TRANSFER_IN_CASH_ADVANCES_AND_LOANS', 'TRANSFER_IN_DEPOSIT', 'TRANSFER_IN_SAVINGS', 'TRANSFER_OUT_ACCOUNT_TRANSFER', 'TRANSFER_OUT_SAVINGS', 'TRANSFER_OUT_WITHDRAWAL'"
_TRANSFER = f"(coalesce(importer_category_primary IN ('TRANSFER_IN', 'TRANSFER_OUT', 'LOAN_PAYMENTS'), FALSE) OR coalesce(importer_category_detailed IN ({_IMPORTER_DETAILS}), FALSE) OR regexp_matches(lower(coalesce(category_primary, '')), '{_CATEGORY_PARTS}') OR regexp_matches(lower(coalesce(category_detailed, '')), '{_CATEGORY_PARTS}') OR regexp_matches(lower(coalesce(merchant_name, '')), '{_TEXT_PARTS}') OR regexp_matches(lower(coalesce(description, '')), '{_TEXT_PARTS}'))"
_INCOME = f"""r AS (SELECT *, {_MERCHANT} AS merchant, CAST(floor(amount + 0.5) AS BIGINT) AS whole FROM tx WHERE amount > 0 AND NOT {_TRANSFER} AND transaction_date BETWEEN DATE '2001-02-01' AND {_D}),
g AS (SELECT *, transaction_date - lag(transaction_date) OVER (PARTITION BY user_id, merchant, whole ORDER BY transaction_date, transaction_id) AS gap FROM r),
s AS (SELECT user_id, merchant, whole, count(*) AS n, avg(gap) AS mean, stddev_pop(gap) AS sigma, CAST((CAST(sum(amount) * 200 AS BIGINT) + count(*)) // (2 * count(*)) * 0.01 AS DECIMAL(19,2)) AS average, max(transaction_date) AS last FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 3),
k AS (SELECT *, CASE WHEN abs(mean - 7) <= 3 THEN 'WEEKLY' WHEN abs(mean - 14) <= 3 THEN 'BIWEEKLY' WHEN mean BETWEEN 13 AND 17 THEN 'SEMI_MONTHLY' WHEN mean BETWEEN 27 AND 33 THEN 'MONTHLY' END AS cadence FROM s),
inc AS (SELECT user_id, merchant, average, n, cadence, round(0.7::DOUBLE * greatest(0.0::DOUBLE, 1 - sigma / mean) + 0.3::DOUBLE * least(1.0::DOUBLE, n / 6.0::DOUBLE), 4) AS confidence, last + CAST(round(mean) AS INT) AS next_date FROM k WHERE cadence IS NOT NULL)"""


@register("d12_recurring_income", "user_id l, merchant s, average m, n l, cadence s, confidence f, next_date d", "tx", f"WITH {_INCOME} SELECT * FROM inc")
def _(tx):
    return R.recurring_income(tx, AS_OF)


@register("d13_upcoming_bills", "user_id l, merchant s, amount m, due d", "tx", f"""
WITH r AS (SELECT *, {_MERCHANT} AS merchant FROM tx WHERE NOT deleted AND amount < 0 AND transaction_date BETWEEN DATE '2001-02-01' AND {_D}),
g AS (SELECT *, transaction_date - lag(transaction_date) OVER (PARTITION BY user_id, merchant ORDER BY transaction_date, transaction_id) AS gap FROM r),
s AS (SELECT user_id, merchant, count(*) AS n, avg(gap) AS mean, (CAST(sum(-amount) * 200 AS BIGINT) + count(*)) // (2 * count(*)) * 0.01 AS amount, max(transaction_date) AS last FROM g GROUP BY 1, 2),
b AS (SELECT *, CAST(round(mean) AS INT) AS step FROM s WHERE n >= 2 AND mean BETWEEN 25 AND 35)
SELECT user_id, merchant, amount, due FROM (SELECT user_id, merchant, amount, last + step * k AS due FROM b CROSS JOIN (SELECT unnest(range(1, 20))::INT AS k)) WHERE due BETWEEN {_D} AND {_D} + 60""")
def _(tx):
    return R.upcoming_bills(tx, AS_OF)


@register("x02_cash_projection", "user_id l, date d, change m, balance m", "tx accounts", f"""WITH {_INCOME},
bu AS (SELECT user_id, CAST((CAST(sum(-amount) * 200 AS BIGINT) + 30) // 60 * 0.01 AS DECIMAL(19,2)) AS burn FROM tx WHERE NOT deleted AND amount < 0 AND NOT {_TRANSFER} AND transaction_date BETWEEN {_D} - 30 AND {_D} GROUP BY 1),
li AS (SELECT user_id, sum(balance) AS liquid FROM accounts WHERE lower(account_type) IN ('checking', 'savings') GROUP BY 1), dd AS (SELECT user_id, next_date AS date, sum(average) AS income FROM inc GROUP BY 1, 2),
sp AS (SELECT user_id, liquid, {_D} + k AS date FROM li CROSS JOIN (SELECT unnest(range(1, 32))::INT AS k)), ch AS (SELECT sp.*, coalesce(income, 0) - coalesce(burn, 0) AS change FROM sp LEFT JOIN bu USING (user_id) LEFT JOIN dd USING (user_id, date))
SELECT user_id, date, change, liquid + sum(change) OVER (PARTITION BY user_id ORDER BY date) AS balance FROM ch""")
def _(tx, accounts):
    return R.cash_projection(tx, accounts, AS_OF)


@register("w05_first_and_last", "user_id l, merchant_name s, first_date d, last_date d, last_amount m, n l", "tx", "SELECT user_id, merchant_name, min(transaction_date) AS first_date, max(transaction_date) AS last_date, arg_max(amount, (transaction_date, transaction_id)) AS last_amount, count(*) AS n FROM tx WHERE merchant_name IS NOT NULL AND amount < 0 GROUP BY 1, 2")
def _(tx):
    return R.first_and_last(tx)


@register("w06_last_rows", "user_id l, merchant_name s, transaction_id s, amount m, place l", "tx", "SELECT *, row_number() OVER (PARTITION BY user_id, merchant_name ORDER BY transaction_date DESC, transaction_id DESC) AS place FROM tx WHERE merchant_name IS NOT NULL AND amount < 0 QUALIFY place <= 3")
def _(tx):
    return R.last_rows(tx)


@register("w08_exponential_average", "user_id l, n_months l, ema f", "tx", """
WITH m AS (SELECT user_id, month, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY month) AS i FROM (SELECT user_id, date_trunc('month', transaction_date) AS month, sum(amount) AS v FROM tx WHERE amount > 0 AND goal_id IS NOT NULL GROUP BY 1, 2)),
e AS (SELECT user_id, i, v AS ema FROM m WHERE i = 1 UNION ALL SELECT m.user_id, m.i, 0.5::DOUBLE * m.v + 0.5::DOUBLE * e.ema FROM e JOIN m ON m.user_id = e.user_id AND m.i = e.i + 1)
SELECT user_id, max(i) AS n_months, round(arg_max(ema, i), 4) AS ema FROM e GROUP BY 1""")
def _(tx):
    return R.exponential_average(tx)


@register("w09_lifestyle_inflation", "user_id l, category_primary s, recent m, prior m, growth m", "tx", f"""
WITH g AS (SELECT user_id, category_primary, coalesce(sum(-amount) FILTER (transaction_date BETWEEN {_D} - 30 AND {_D}), 0) AS recent, CAST((CAST(coalesce(sum(-amount) FILTER (transaction_date BETWEEN {_D} - 90 AND {_D} - 30), 0) * 200 AS BIGINT) + 2) // 4 * 0.01 AS DECIMAL(19,2)) AS prior
  FROM tx WHERE NOT coalesce(is_hidden, FALSE) AND amount < 0 AND category_primary IS NOT NULL AND transaction_date BETWEEN {_D} - 90 AND {_D} GROUP BY 1, 2)
SELECT *, round((recent - prior) / prior, 4) AS growth FROM g WHERE prior > 0 AND round((recent - prior) / prior, 4) > 0.15""")
def _(tx):
    return R.lifestyle_inflation(tx, AS_OF)


@register("w11_anchors", "user_id l, merchant_name s, n l, anchor s, day l", "tx", """
WITH r AS (SELECT user_id, merchant_name, transaction_date FROM tx WHERE merchant_name IS NOT NULL AND amount < 0), n AS (SELECT user_id, merchant_name, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 3),
w AS (SELECT user_id, merchant_name, arg_max(d, (k, -d)) AS weekday, max(k) AS wn FROM (SELECT user_id, merchant_name, dayofweek(transaction_date) + 1 AS d, count(*) AS k FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
m AS (SELECT user_id, merchant_name, arg_max(d, (k, -d)) AS monthday, max(k) AS mn FROM (SELECT user_id, merchant_name, d, count(*) AS k FROM (SELECT user_id, merchant_name, unnest(range(greatest(1, day(transaction_date) - 2), least(31, day(transaction_date) + 2) + 1)) AS d FROM r) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT user_id, merchant_name, n, CASE WHEN wn >= 0.8 * n THEN 'WEEKDAY' ELSE 'MONTHDAY' END AS anchor, CASE WHEN wn >= 0.8 * n THEN weekday ELSE monthday END AS day FROM n JOIN w USING (user_id, merchant_name) JOIN m USING (user_id, merchant_name) WHERE wn >= 0.8 * n OR mn >= 0.8 * n""")
def _(tx):
    return R.anchors(tx)
