"""Registered queries of operators.anomalies."""

from ledgerlake.adapter import AS_OF
from ledgerlake.operators import anomalies as X
from ledgerlake.registry import register

_D = "DATE '2001-08-01'"
_MERCHANT = "lower(CASE WHEN trim(coalesce(merchant_name, '')) <> '' THEN trim(merchant_name) ELSE trim(split_part(trim(description), ' - ', 1)) END)"
_BASE = f"""WITH e AS (SELECT *, abs(amount) AS spent, {_MERCHANT} AS merchant, lower(coalesce(category_primary, category_detailed, 'other')) AS category FROM tx WHERE NOT deleted AND NOT coalesce(is_hidden, FALSE) AND amount < 0),
rec AS (SELECT * FROM e WHERE transaction_date BETWEEN {_D} - 90 AND {_D}), his AS (SELECT * FROM e WHERE transaction_date BETWEEN {_D} - 180 AND {_D} - 90)"""
_SENS = ", sens AS (SELECT user_id, CASE anomaly_sensitivity WHEN 'LOOSE' THEN 1.5::DOUBLE WHEN 'STRICT' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS s FROM preferences)"
_OUT = "user_id l, transaction_id s, kind s, severity s, amount m"

_D01 = """, m1 AS (SELECT user_id, count(*) AS n, round(avg(spent), 2) AS mean FROM his GROUP BY 1 HAVING count(*) >= 10),
sd AS (SELECT user_id, any_value(mean) AS mean, round(sqrt(round(avg((CAST(spent AS DOUBLE) - mean) * (CAST(spent AS DOUBLE) - mean)), 4)), 4) AS sigma FROM his JOIN m1 USING (user_id) GROUP BY 1),
d01 AS (SELECT user_id, transaction_id, 'OUTLIER' AS kind, CASE WHEN spent > 500 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, spent AS amount FROM rec JOIN sd USING (user_id) LEFT JOIN sens USING (user_id)
  WHERE sigma > 0 AND user_id IN (SELECT user_id FROM rec GROUP BY 1 HAVING count(*) >= 10) AND abs((CAST(spent AS DOUBLE) - mean) / sigma) > {z} * coalesce(s, 1.0))"""
_D02 = """, hc AS (SELECT user_id, category, round(avg(spent), 2) AS past FROM his GROUP BY 1, 2), rc AS (SELECT user_id, category, round(avg(spent), 2) AS now, arg_max(transaction_id, (spent, transaction_id)) AS transaction_id, max(spent) AS amount FROM rec GROUP BY 1, 2),
d02 AS (SELECT user_id, transaction_id, 'CATEGORY_SPIKE' AS kind, 'MEDIUM' AS severity, amount FROM rc JOIN hc USING (user_id, category) LEFT JOIN sens USING (user_id) WHERE past > 0 AND now > {times} * coalesce(s, 1.0) * past)"""
_D03 = """, d03 AS (SELECT user_id, transaction_id, 'NEW_MERCHANT' AS kind, 'LOW' AS severity, spent AS amount FROM (SELECT *, row_number() OVER (PARTITION BY user_id, merchant ORDER BY transaction_date, transaction_id) AS r FROM rec WHERE merchant <> '') n
  WHERE r = 1 AND spent > 100 AND category NOT IN ('rent', 'rent_and_utilities', 'mortgage', 'loan', 'loan_payment', 'utilities', 'insurance', 'tax', 'interest_charged', 'interest') AND NOT EXISTS (SELECT 1 FROM his h WHERE h.user_id = n.user_id AND h.merchant = n.merchant))"""
_D04 = """, d04 AS (SELECT user_id, transaction_id, 'DUPLICATE' AS kind, 'HIGH' AS severity, spent AS amount FROM (SELECT *, lead(transaction_date) OVER (PARTITION BY user_id, merchant, floor((spent * 100 + 250) / 500) ORDER BY transaction_date, transaction_id) AS nx FROM rec WHERE spent >= {least}) WHERE nx - transaction_date <= {days})"""
_D05 = """, md AS (SELECT user_id, round(quantile_cont(CAST(spent * 100 AS BIGINT), 0.5)) / 100 AS median FROM his GROUP BY 1),
d05 AS (SELECT user_id, transaction_id, 'THRESHOLD' AS kind, CASE WHEN spent > 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, spent AS amount FROM rec JOIN md USING (user_id) LEFT JOIN sens USING (user_id) WHERE median > 0 AND spent > {times} * coalesce(s, 1.0) * median)"""


@register("d01_statistical_outliers", _OUT, "tx preferences", _BASE + _SENS + _D01.format(z=1.2) + " SELECT * FROM d01")
def _(tx, preferences):
    return X.statistical_outliers(tx, preferences, AS_OF, z=1.2)


@register("d02_category_spikes", _OUT, "tx preferences", _BASE + _SENS + _D02.format(times=1.1) + " SELECT * FROM d02")
def _(tx, preferences):
    return X.category_spikes(tx, preferences, AS_OF, times=1.1)


@register("d03_first_time_merchants", _OUT, "tx", _BASE + _D03 + " SELECT * FROM d03")
def _(tx):
    return X.first_time_merchants(tx, AS_OF)


@register("d04_duplicate_charges", _OUT, "tx", _BASE + _D04.format(least=5, days=20) + " SELECT * FROM d04")
def _(tx):
    return X.duplicate_charges(tx, AS_OF, least=5, days=20)


#: The same over the frame tx with the detector's own thresholds, for queries that unite detectors.
DUPLICATES_SQL = f"{_BASE}{_D04.format(least=50, days=1)} SELECT * FROM d04"


@register("d05_over_median", _OUT, "tx preferences", _BASE + _SENS + _D05.format(times=1.7) + " SELECT * FROM d05")
def _(tx, preferences):
    return X.over_median(tx, preferences, AS_OF, times=1.7)


@register("d06_anomalies", _OUT + ", place l", "tx preferences feedback", _BASE + _SENS + _D01.format(z=2.5) + _D02.format(times=3.0) + _D03 + _D04.format(least=50, days=1) + _D05.format(times=5.0) + """,
al AS (SELECT * FROM d01 UNION ALL SELECT * FROM d02 UNION ALL SELECT * FROM d03 UNION ALL SELECT * FROM d04 UNION ALL SELECT * FROM d05),
fp AS (SELECT user_id, transaction_id, merchant || '|' || category || '|' || CAST(floor((spent * 100 + 1000) / 2000) * 20 AS BIGINT) AS f FROM e),
dis AS (SELECT DISTINCT fp.user_id, f FROM feedback JOIN fp USING (user_id, transaction_id) WHERE verdict = 'DISMISSED'),
op AS (SELECT al.* FROM al JOIN fp USING (user_id, transaction_id) WHERE NOT EXISTS (SELECT 1 FROM dis WHERE dis.user_id = al.user_id AND dis.f = fp.f)),
rk AS (SELECT *, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rank FROM op),
one AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY user_id, transaction_id ORDER BY rank DESC, kind) = 1)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, amount DESC, transaction_id) AS place FROM one""")
def _(tx, preferences, feedback):
    return X.anomalies(tx, preferences, feedback, AS_OF)


@register("d07_near_duplicates_across_accounts", "user_id l, merchant s, transaction_id s, earlier_id s, days_apart l", "tx", f"""
WITH r AS (SELECT user_id, lower(trim(merchant_name)) AS merchant, CAST(floor(-amount + 0.5) AS BIGINT) AS whole, transaction_id, account_id, transaction_date FROM tx WHERE NOT deleted AND amount < 0 AND merchant_name IS NOT NULL AND transaction_date BETWEEN {_D} - 2000 AND {_D})
SELECT a.user_id, a.merchant, a.transaction_id, b.transaction_id AS earlier_id, a.transaction_date - b.transaction_date AS days_apart FROM r a JOIN r b ON a.user_id = b.user_id AND a.merchant = b.merchant AND a.whole = b.whole AND a.account_id <> b.account_id
  AND a.transaction_date - b.transaction_date BETWEEN 0 AND 60 AND (a.transaction_date > b.transaction_date OR b.transaction_id < a.transaction_id)
QUALIFY row_number() OVER (PARTITION BY a.user_id, a.transaction_id ORDER BY b.transaction_date DESC, b.transaction_id DESC) = 1""")
def _(tx):
    return X.near_duplicates_across_accounts(tx, AS_OF, days=2000, reach=60)


@register("d10_missed_actions", "action_id s, user_id l, late l, severity s", "actions tx", f"""
SELECT action_id, user_id, {_D} - due_date AS late, CASE WHEN {_D} - due_date > 7 THEN 'HIGH' WHEN {_D} - due_date > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM actions a WHERE NOT is_completed AND due_date - {_D} <= 3
AND NOT EXISTS (SELECT 1 FROM tx t WHERE t.user_id = a.user_id AND NOT t.deleted AND t.transaction_date BETWEEN a.due_date - 7 AND a.due_date + 7 AND (contains(lower(concat_ws(' ', merchant_name, t.description)), lower(a.title)) OR contains(lower(concat_ws(' ', merchant_name, t.description)), lower(a.description))))""")
def _(actions, tx):
    return X.missed_actions(actions, tx, AS_OF)


@register("d11_missed_pattern_breaks", "user_id l, merchant s, amount m, n l, expected d, days_late l", "tx", f"""
WITH r AS (SELECT user_id, {_MERCHANT} AS merchant, -amount AS spent, transaction_date, transaction_id FROM tx WHERE NOT coalesce(is_hidden, FALSE) AND amount < 0 AND transaction_date BETWEEN {_D} - 300 AND {_D}
  AND lower(coalesce(category_primary, category_detailed, 'other')) NOT IN ('dining', 'groceries', 'shopping', 'transportation', 'entertainment', 'travel', 'healthcare', 'health', 'personal_care', 'other')),
g AS (SELECT *, transaction_date - lag(transaction_date) OVER (PARTITION BY user_id, merchant, spent ORDER BY transaction_date, transaction_id) AS gap FROM r),
s AS (SELECT user_id, merchant, spent, count(*) AS n, avg(gap) AS mean, stddev_pop(gap) AS sigma, max(transaction_date) AS last FROM g GROUP BY 1, 2, 3)
SELECT user_id, merchant, spent AS amount, n, last + CAST(floor(mean) AS INT) AS expected, {_D} - (last + CAST(floor(mean) AS INT)) AS days_late FROM s WHERE n >= 3 AND sigma <= 4 AND (mean BETWEEN 25 AND 35 OR mean BETWEEN 12 AND 16) AND {_D} - (last + CAST(floor(mean) AS INT)) > 7""")
def _(tx):
    return X.missed_pattern_breaks(tx, AS_OF, window=300)
