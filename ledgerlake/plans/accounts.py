"""Registered queries of operators.accounts."""

from ledgerlake.adapter import AS_OF
from ledgerlake.operators import accounts as C
from ledgerlake.registry import register

_D = "DATE '2001-08-01'"


@register("x10_card_insights", "user_id l, account_id l, kind s, severity s, value f", "accounts", f"""
WITH c AS (SELECT *, (CAST(abs(balance) * 2000000 AS BIGINT) + CAST(credit_limit * 100 AS BIGINT)) // CAST(credit_limit * 200 AS BIGINT) * 0.0001 AS used FROM accounts WHERE active AND account_type = 'creditCard')
SELECT user_id, account_id, 'PAST_DUE' AS kind, 'HIGH' AS severity, CAST(past_due_amount AS DOUBLE) AS value FROM c WHERE past_due_amount > 0
UNION ALL SELECT user_id, account_id, 'HIGH_UTILIZATION', CASE WHEN used > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END, used FROM c WHERE used > 0.3
UNION ALL SELECT user_id, account_id, 'AUTOPAY_OFF', 'LOW', 0 FROM c WHERE autopay_enabled IS NOT DISTINCT FROM FALSE
UNION ALL SELECT user_id, account_id, 'ANNUAL_FEE', 'LOW', annual_fee FROM c WHERE annual_fee > 0 AND annual_fee_due - {_D} BETWEEN 0 AND 30""")
def _(accounts):
    return C.card_insights(accounts, AS_OF)


@register("x09_high_interest", "user_id l, account_id l, source s, annual m", "tx accounts", """
WITH i AS (SELECT user_id, account_id, sum(-amount) AS paid, count(DISTINCT date_trunc('month', transaction_date)) AS months FROM tx WHERE amount < 0 AND regexp_matches(lower(concat_ws(' ', category_primary, category_detailed, description)), '\\b(interest|finance\\s*charge)\\b') GROUP BY 1, 2)
SELECT i.user_id, account_id, 'CHARGED' AS source, (CAST(paid * 200 AS BIGINT) + months) // (2 * months) * 0.12 AS annual FROM i JOIN accounts USING (account_id)
UNION ALL SELECT user_id, account_id, 'CARD_APR', round(abs(balance) * apr_percent * 0.01, 2) FROM accounts WHERE account_type = 'creditCard' AND apr_percent >= 15 AND round(abs(balance) * apr_percent * 0.01, 2) > 500
UNION ALL SELECT user_id, account_id, 'LOAN_RATE', round(abs(balance) * CASE account_type WHEN 'autoLoan' THEN 0.08 ELSE 0.15 END, 2) FROM accounts WHERE balance < 0 AND account_type IN ('autoLoan', 'personalLoan') AND round(abs(balance) * CASE account_type WHEN 'autoLoan' THEN 0.08 ELSE 0.15 END, 2) > 1000""")
def _(tx, accounts):
    return C.high_interest(tx, accounts)


@register("x12_balance_drift", "account_id l, user_id l, since d, snapshot_date d, change m, explained m, drift m, level s", "balances accounts tx", """
WITH p AS (SELECT account_id, snapshot_date, lag(snapshot_date) OVER w AS since, balance - lag(balance) OVER w AS change FROM balances WINDOW w AS (PARTITION BY account_id ORDER BY snapshot_date)),
j AS (SELECT p.account_id, user_id, account_type, since, snapshot_date, change, (SELECT coalesce(sum(amount), 0) FROM tx WHERE NOT deleted AND tx.account_id = p.account_id AND transaction_date BETWEEN since AND snapshot_date) AS moved FROM p JOIN accounts a ON a.account_id = p.account_id WHERE since IS NOT NULL),
e AS (SELECT *, CASE WHEN regexp_matches(lower(account_type), 'credit|loan|mortgage') THEN -moved ELSE moved END AS explained FROM j)
SELECT account_id, user_id, since, snapshot_date, change, explained, change - explained AS drift, CASE WHEN abs(change - explained) >= 10 THEN 'WARN' WHEN abs(change - explained) >= 1 THEN 'INFO' END AS level FROM e""")
def _(balances, accounts, tx):
    return C.balance_drift(balances, accounts, tx)


@register("x15_daily_read", "user_id l, used m, liquid m, outflow m, state s", "accounts tx", f"""
WITH s AS (SELECT user_id, coalesce(sum(abs(balance)) FILTER (account_type = 'creditCard'), 0) AS owed, coalesce(sum(credit_limit) FILTER (account_type = 'creditCard'), 0) AS limits, coalesce(sum(balance) FILTER (lower(account_type) IN ('checking', 'savings')), 0) AS liquid FROM accounts WHERE active GROUP BY 1),
o AS (SELECT user_id, sum(-amount) AS outflow FROM tx WHERE NOT deleted AND amount < 0 AND lower(coalesce(category_primary, '')) NOT IN ('transfer', 'payment') AND transaction_date BETWEEN {_D} - 30 AND {_D} GROUP BY 1),
j AS (SELECT user_id, coalesce(round(owed / nullif(limits, 0), 4), 0) AS used, liquid, coalesce(outflow, 0) AS outflow FROM s LEFT JOIN o USING (user_id))
SELECT *, CASE WHEN used >= 0.5 THEN 'ALERT' WHEN used >= 0.3 THEN 'CAUTION' WHEN liquid < outflow * 0.33 THEN 'CAUTION' ELSE 'STEADY' END AS state FROM j""")
def _(accounts, tx):
    return C.daily_read(accounts, tx, AS_OF)


@register("p09_account_payments", "account_id l, account_type s, transaction_id s, amount m", "tx accounts", "SELECT account_id, account_type, transaction_id, amount FROM tx JOIN accounts USING (account_id) WHERE (account_type IN ('mortgage', 'autoLoan', 'personalLoan', 'studentLoan') AND amount > 0) OR (account_type = 'creditCard' AND (amount > 0 OR contains(lower(coalesce(category_primary, '')), 'payment')))")
def _(tx, accounts):
    return C.account_payments(tx, accounts)
