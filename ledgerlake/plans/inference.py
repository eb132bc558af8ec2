"""Registered queries of operators.inference."""

from pyspark.sql import functions as F

from ledgerlake.operators import inference as N
from ledgerlake.operators.categorise import MERCHANT_CODES
from ledgerlake.registry import register


@register("f34_transaction_types", "transaction_id s, kind s, type s, confidence f", "tx accounts", """
WITH j AS (SELECT transaction_id, amount, lower(trim(coalesce(description, ''))) AS x, CASE WHEN lower(account_type) IN ('creditcard', 'credit', 'credit_card', 'charge_card') THEN 'card' WHEN lower(account_type) IN ('investment', 'brokerage', '401k', 'ira', 'hsa', '529') THEN 'investment' WHEN lower(account_type) IN ('loan', 'mortgage', 'autoloan', 'personalloan', 'studentloan') THEN 'loan' WHEN lower(account_type) IN ('checking', 'savings', 'money_market', 'cash') THEN 'deposit' END AS kind FROM tx LEFT JOIN accounts USING (account_id)),
f AS (SELECT *, regexp_matches(x, 'payment received|payment thank you|thank you for your payment|autopay payment') AS received, regexp_matches(x, 'fee|charge|commission|tax|custodial|maintenance|sales load|expense ratio') AS fee, regexp_matches(x, 'credit card payment|card payment|cardmember|epay|autopay') AS paid FROM j)
SELECT transaction_id, kind, CASE WHEN amount = 0 THEN NULL WHEN kind = 'card' THEN CASE WHEN amount > 0 AND NOT received THEN 'EXPENSE' ELSE 'PAYMENT' END WHEN kind = 'investment' THEN CASE WHEN amount > 0 THEN 'INCOME' WHEN fee THEN 'EXPENSE' ELSE 'INVESTMENT' END WHEN kind = 'loan' THEN CASE WHEN amount < 0 THEN 'EXPENSE' ELSE 'PAYMENT' END
  WHEN kind = 'deposit' THEN CASE WHEN amount > 0 THEN 'INCOME' WHEN paid THEN 'PAYMENT' ELSE 'EXPENSE' END WHEN amount > 0 THEN 'INCOME' ELSE 'EXPENSE' END AS type,
  CASE WHEN amount = 0 THEN NULL WHEN kind = 'loan' AND amount > 0 AND NOT received THEN 0.90 WHEN kind IS NULL THEN 0.60 ELSE 0.95 END AS confidence FROM f""")
def _(tx, accounts):
    return N.typed(tx, accounts)


_CODES = ", ".join(str(c) for c, _ in MERCHANT_CODES)


@register("c02_merchant_codes", "transaction_id s, code l, category s", "tx", f"SELECT transaction_id, code, category FROM (SELECT transaction_id, [{_CODES}, 1, 2][CAST(updated_at_ts % 10 AS INT) + 1] AS code FROM tx) JOIN (VALUES {', '.join(f'({c}, {chr(39)}{k}{chr(39)})' for c, k in MERCHANT_CODES)}) AS d(code, category) USING (code)")
def _(tx):
    code = F.element_at(F.array(*[F.lit(c) for c, _ in MERCHANT_CODES], F.lit(1), F.lit(2)), (F.col("updated_at_ts") % 10 + 1).cast("int"))
    return N.by_merchant_code(tx.select("transaction_id", code.alias("code")))


@register("c10_semantic_match", "transaction_id s, cluster s, score f", "tx", """
WITH r AS (SELECT transaction_id, lower(category_primary) AS own, list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', merchant_name, description)), '[^a-z]+'), lambda t: t <> '')) AS tk FROM tx),
c(cluster, words) AS (VALUES ('streaming', ['streamly', 'subscription', 'video']), ('salary', ['payroll', 'deposit', 'salary']), ('shopping', ['merchant', 'store', 'pos']), ('utilities', ['power', 'water', 'medium'])),
s AS (SELECT transaction_id, cluster, len(list_intersect(tk, words)) AS k, len(tk) AS n, len(words) AS m, own FROM r CROSS JOIN c), p AS (SELECT transaction_id, cluster, round(k / CAST(n + m - k AS DOUBLE) + CASE WHEN own = cluster THEN 0.1 ELSE 0 END, 6) AS score FROM s WHERE k > 0)
SELECT * FROM p WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY score DESC, cluster) = 1""")
def _(tx):
    return N.semantic_match(tx)
