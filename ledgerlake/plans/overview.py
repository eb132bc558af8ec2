"""Registered queries of operators.overview and functions.masking."""

from pyspark.sql import functions as F

from ledgerlake.adapter import AS_OF
from ledgerlake.functions import masking as K
from ledgerlake.operators import accounts as C
from ledgerlake.operators import anomalies as X
from ledgerlake.operators import overview as V
from ledgerlake.operators import subscriptions as S
from ledgerlake.plans import anomalies, subscriptions as _needed  # noqa: F401
from ledgerlake.plans.accounts import _D
from ledgerlake.registry import register, sql_of


_FOUND = f"""SELECT user_id, 'anomalies' AS detector, severity FROM ({sql_of("d06_anomalies")}) UNION ALL SELECT user_id, 'duplicates', 'HIGH' FROM ({anomalies.DUPLICATES_SQL})
UNION ALL SELECT user_id, 'cards', severity FROM ({sql_of("x10_card_insights")}) UNION ALL SELECT user_id, 'idle', severity FROM ({sql_of("d16_unused")})"""


@register("a26_insights_summary", "user_id l, anomalies l, duplicates l, cards l, idle l, high l, annual_savings m", "tx preferences feedback accounts subscriptions", f"""WITH al AS ({_FOUND}), sv AS (SELECT user_id, sum(saving) * 12 AS annual_savings FROM ({sql_of("d18_cancellations")}) GROUP BY 1),
n AS (SELECT user_id, count(*) FILTER (detector = 'anomalies') AS anomalies, count(*) FILTER (detector = 'duplicates') AS duplicates, count(*) FILTER (detector = 'cards') AS cards, count(*) FILTER (detector = 'idle') AS idle, count(*) FILTER (severity = 'HIGH') AS high FROM al GROUP BY 1)
SELECT n.*, round(coalesce(annual_savings, 0), 2) AS annual_savings FROM n LEFT JOIN sv USING (user_id)""")
def _(tx, preferences, feedback, accounts, subscriptions):
    idle = S.unused(subscriptions, tx, AS_OF)
    found = {"anomalies": X.anomalies(tx, preferences, feedback, AS_OF), "duplicates": X.duplicate_charges(tx, AS_OF), "cards": C.card_insights(accounts, AS_OF), "idle": idle}
    return V.insights_summary(found, S.cancellations(subscriptions, tx, AS_OF))


@register("a24_privacy_snapshot", "user_id l, month d, category s, spent l, n l, known_merchants l", "tx", f"""
WITH r AS (SELECT * FROM tx WHERE NOT deleted AND amount < 0 AND transaction_date BETWEEN {_D} - 90 AND {_D}), k AS (SELECT user_id, count(*) AS known_merchants FROM (SELECT user_id, merchant_name FROM r WHERE merchant_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
g AS (SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, coalesce(category_primary, 'other') AS category, (CAST(sum(-amount) * 100 AS BIGINT) + 500) // 1000 * 10 AS spent, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT g.*, coalesce(known_merchants, 0) AS known_merchants FROM g LEFT JOIN k USING (user_id)""")
def _(tx):
    return V.privacy_snapshot(tx, AS_OF)


@register("a27_miss_ranking", "user_id l, status s, misses l, mean_rows f", "imports", "SELECT user_id, status, count(*) AS misses, round(avg(successful), 4) AS mean_rows FROM imports WHERE status <> 'COMPLETED' GROUP BY 1, 2")
def _(imports):
    return V.miss_ranking(imports)


@register("d22_alternatives", "subscription_id s, user_id l, offer s, saving m, place l", "subscriptions", """
WITH o(category, offer, offer_price) AS (VALUES ('streaming', 'Basic view', 7.99), ('streaming', 'Family view', 12.99), ('software', 'Open suite', 0.00), ('fitness', 'Park club', 15.00))
SELECT subscription_id, user_id, offer, amount - offer_price AS saving, row_number() OVER (PARTITION BY subscription_id ORDER BY offer_price, offer) AS place FROM subscriptions JOIN o USING (category) WHERE active AND frequency = 'MONTHLY' AND offer_price < amount""")
def _(subscriptions):
    return V.alternatives(subscriptions, [("streaming", "Basic view", "7.99"), ("streaming", "Family view", "12.99"), ("software", "Open suite", "0.00"), ("fitness", "Park club", "15.00")])


@register("d27_usage_likelihood", "vec_id l, unlikely f", sql="""
WITH p AS (SELECT a.vec_id, avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1) SELECT vec_id, round(1 - s, 6) AS unlikely FROM p""")
def _(spark, sf_dir):
    return V.usage_likelihood(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@register("j17_merchant_clusters", "user_id l, cluster s, merchant s", "tx")
def _(tx):
    return V.merchant_clusters(tx)


@register("j20_match_accounts", "detected_id s, account_id l, rank l", "imports accounts", """
WITH d AS (SELECT import_id AS detected_id, user_id, 'Bank ' || CAST(successful % 25 AS VARCHAR) AS institution, 'none' AS name, CASE WHEN failed % 2 = 0 THEN 'checking' ELSE 'creditCard' END AS type FROM imports),
j AS (SELECT detected_id, account_id, CASE WHEN lower(institution) = lower(institution_name) AND lower(name) = lower(account_name) THEN 1 WHEN lower(institution) = lower(institution_name) AND type = account_type THEN 2 WHEN type = account_type THEN 3 END AS rank FROM d JOIN accounts a ON a.user_id = d.user_id)
SELECT * FROM j WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY detected_id ORDER BY rank, account_id) = 1""")
def _(imports, accounts):
    kind = F.when(F.col("failed") % 2 == 0, "checking").otherwise("creditCard")
    detected = imports.select(F.col("import_id").alias("detected_id"), "user_id", F.concat(F.lit("Bank "), (F.col("successful") % 25).cast("string")).alias("institution"), F.lit("none").alias("name"), kind.alias("type"))
    return V.match_accounts(detected, accounts)


@register("p12_cadence_groups", "user_id l, merchant_name s, n l, gap f, mean m", "tx", """
WITH g AS (SELECT *, transaction_date - lag(transaction_date) OVER (PARTITION BY user_id, merchant_name ORDER BY transaction_date, transaction_id) AS gap FROM tx WHERE merchant_name IS NOT NULL AND amount < 0),
s AS (SELECT user_id, merchant_name, count(*) AS n, avg(gap) AS gap, CAST((CAST(sum(-amount) * 200 AS BIGINT) + count(*)) // (2 * count(*)) * 0.01 AS DECIMAL(19,2)) AS mean, min(-amount) AS low, max(-amount) AS high FROM g GROUP BY 1, 2)
SELECT user_id, merchant_name, n, round(gap, 4) AS gap, mean FROM s WHERE n >= 3 AND len(list_filter([7, 14, 15, 30, 31, 60, 90, 180, 365], lambda c: abs(gap - c) <= 5)) > 0 AND high - mean <= mean * 0.10 AND mean - low <= mean * 0.10""")
def _(tx):
    return V.cadence_groups(tx)


@register("p14_resumable", "import_id s, user_id l, status s, successful l", "imports", "SELECT * FROM imports WHERE status IN ('FAILED', 'PARTIAL') AND successful > 0")
def _(imports):
    return V.resumable(imports)


@register("s10_user_accounts", "user_id l, account_id l, account_type s, balance m", "accounts", "SELECT * FROM accounts WHERE account_type = 'creditCard'")
def _(accounts):
    return V.user_accounts(accounts, kind="creditCard")


@register("s11_user_budgets", "user_id l, budget_id s, category s, monthly_limit m", "budgets", "SELECT * FROM budgets WHERE rollover_enabled")
def _(budgets):
    return V.user_budgets(budgets, rolling=True)


@register("w03_daily_totals", "user_id l, transaction_date d, spent m, so_far m", "tx", f"""
WITH d AS (SELECT user_id, transaction_date, coalesce(sum(-amount) FILTER (amount < 0), 0) AS spent FROM tx WHERE NOT deleted AND transaction_date BETWEEN DATE '2001-01-01' AND {_D} GROUP BY 1, 2) SELECT *, sum(spent) OVER (PARTITION BY user_id ORDER BY transaction_date) AS so_far FROM d""")
def _(tx):
    return V.daily_totals(tx, "2001-01-01", AS_OF)


@register("f45_masks", "account_id l, number s, email s", "accounts", "SELECT account_id, CASE WHEN length(CAST(account_id AS VARCHAR)) <= 4 THEN CAST(account_id AS VARCHAR) ELSE 'X' || right(CAST(account_id AS VARCHAR), 4) END AS number, left(lower(account_name), 1) || '*@mail.example.com' AS email FROM accounts")
def _(accounts):
    number = F.col("account_id").cast("string")
    return accounts.select("account_id", K.mask_account(number).alias("number"), K.mask_email(F.concat(F.lower("account_name"), F.lit("@mail.example.com"))).alias("email"))


@register("f35_locations", "description s, merchant s, city s, state s", "accounts", "SELECT DISTINCT 'Shop ' || institution_name || ' Springfield IL' AS description, 'Shop ' || institution_name AS merchant, 'Springfield' AS city, 'IL' AS state FROM accounts")
def _(accounts):
    rows = accounts.select(F.concat(F.lit("Shop "), "institution_name", F.lit(" Springfield IL")).alias("description")).distinct()
    return rows.select("description", K.split_location(F.col("description")).alias("x")).select("description", "x.*")


@register("f39_fingerprints", "user_id l, fingerprint s", "imports", """
SELECT user_id, left(sha1(CASE WHEN max(successful) FILTER (successful > 0) IS NOT NULL THEN '1' ELSE '0' END || CASE WHEN max(failed) FILTER (failed > 5) IS NOT NULL THEN '1' ELSE '0' END || '|' || CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) < 10 THEN 'few' WHEN count(*) < 50 THEN 'some' ELSE 'many' END), 12) AS fingerprint FROM imports GROUP BY user_id""")
def _(imports):
    g = imports.groupBy("user_id").agg(F.max(F.when(F.col("successful") > 0, 1)).alias("a"), F.max(F.when(F.col("failed") > 5, 1)).alias("b"), F.count("*").alias("n"))
    return g.select("user_id", K.format_fingerprint({"a": F.col("a"), "b": F.col("b")}, F.col("n")).alias("fingerprint"))
