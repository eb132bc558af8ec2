"""Registered queries of the event stream, in their batch forms."""

import uuid

from pyspark.sql import functions as F

from ledgerlake.registry import register
from ledgerlake.sources.keyed import KeyedTable, adopted, settled, shared_folder
from ledgerlake.streaming import activity as S


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@register("t02_blocked_sources", "user_id l, begins s, n l", sql="SELECT user_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS begins, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 3")
def _(spark, sf_dir):
    return S.blocked_sources(_events(spark, sf_dir), "1 day").withColumn("begins", F.date_format("begins", "yyyy-MM-dd HH:mm:ss"))


@register("t03_window_counts", "user_id l, begins s, n l, total f", sql="SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS begins, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return S.window_counts(_events(spark, sf_dir)).withColumn("begins", F.date_format("begins", "yyyy-MM-dd HH:mm:ss"))


@register("t13_sessions", "user_id l, begins s, n l", sql="""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, sf_dir):
    return S.sessions(_events(spark, sf_dir), "12 hours").withColumn("begins", F.date_format("begins", "yyyy-MM-dd HH:mm:ss"))


@register("t07_once", "event_id l, user_id l", sql="SELECT event_id, any_value(user_id) AS user_id FROM events GROUP BY event_id")
def _(spark, sf_dir):
    return S.once(_events(spark, sf_dir))


@register("t04_token_bucket", "user_id l, event_id l, allowed b")
def _(spark, sf_dir):
    return S.token_bucket(_events(spark, sf_dir))


_AT = "TIMESTAMP '2024-01-30 12:00:00'"


@register("d09_behaviour_risk", "event_id l, user_id l, risk f, level s", sql=f"""
WITH a AS (SELECT event_id, user_id, ts, event_type AS kind, CASE event_type WHEN 'purchase' THEN '/api/transactions' WHEN 'error' THEN '/admin/log' ELSE '/' || event_type END AS resource, CASE event_type WHEN 'purchase' THEN 'create' WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'UPDATE' ELSE 'READ' END AS action FROM events WHERE ts <= {_AT}),
p AS (SELECT user_id, count(*) AS n, count(*) FILTER (ts > {_AT} - INTERVAL 1 HOUR) AS nr, count(*) FILTER (hour(ts) = 12) AS nh, (epoch_us({_AT}) - epoch_us(min(ts))) // 3600000000 AS age FROM a GROUP BY 1),
j AS (SELECT *, count(*) OVER (PARTITION BY user_id, kind) AS nk, count(*) OVER (PARTITION BY user_id, resource) AS nres, count(*) OVER (PARTITION BY user_id, action) AS na FROM a),
f AS (SELECT event_id, j.user_id, CASE WHEN 10 * nk < n THEN 50 WHEN 10 * nres < n THEN 40 WHEN 10 * na < n THEN 30 ELSE 0 END AS pattern, CASE WHEN regexp_matches(resource, '/admin|/compliance|/audit') THEN 80 WHEN regexp_matches(resource, '/api/transactions|/api/accounts|/api/budgets') THEN 50 ELSE 20 END AS res,
  CASE WHEN upper(action) IN ('DELETE', 'UPDATE') THEN 70 WHEN upper(action) = 'CREATE' THEN 40 ELSE 10 END AS act, CASE WHEN 10 * nh < n THEN 60 WHEN 10 * nh < 3 * n THEN 30 ELSE 0 END AS tim, CASE WHEN age <= 0 OR nr > 3.0 * n / age THEN 70 WHEN nr > 2.0 * n / age THEN 40 WHEN nr < 0.3 * n / age THEN 20 ELSE 0 END AS fre FROM j JOIN p USING (user_id) WHERE ts > {_AT} - INTERVAL 1 HOUR),
r AS (SELECT event_id, user_id, round((15 * pattern + 13 * res + 12 * act + 10 * tim + 8 * fre) / 75.0::DOUBLE, 4) AS risk FROM f)
SELECT *, CASE WHEN risk >= 70 THEN 'HIGH' WHEN risk >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")
def _(spark, sf_dir):
    kind = F.col("event_type")
    resource = F.when(kind == "purchase", "/api/transactions").when(kind == "error", "/admin/log").otherwise(F.concat(F.lit("/"), kind))
    action = F.when(kind == "purchase", "create").when(kind == "error", "DELETE").when(kind == "signup", "UPDATE").otherwise("READ")
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", kind.alias("kind"), resource.alias("resource"), action.alias("action"))
    return S.behaviour_risk(rows, F.lit("2024-01-30 12:00:00").cast("timestamp"))


@register("t08_keyed_merge", "user_id l, event_id l, value f", sql="""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'error' DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, value FROM w WHERE r = 1 AND event_type <> 'error'""")
def _(spark, sf_dir):
    """Users' latest events, errors as deletions, merged in three batches of which each holds early and late rows."""
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", "value", (F.col("event_type") == "error").alias("deleted"))
    table = KeyedTable(spark, f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}", "user_id", "ts", buckets=8)
    for batch in range(3):
        table.merge(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch))
    return table.read()


_FEED = "nullif(CASE WHEN import_source = 'PLAID' THEN plaid_transaction_id END, '')"


@register("t08_settled", "transaction_id s, user_id l, goal_id s", "tx", f"""
WITH r AS (SELECT transaction_id, user_id, goal_id, pending, CASE WHEN NOT pending AND try_cast(transaction_id AS BIGINT) % 20 BETWEEN 1 AND 4 THEN CAST(try_cast(transaction_id AS BIGINT) - try_cast(transaction_id AS BIGINT) % 20 AS VARCHAR) END AS link FROM tx),
pe AS (SELECT * FROM r WHERE pending), go AS (SELECT DISTINCT p.transaction_id FROM pe p JOIN r ON NOT r.pending AND r.link = p.transaction_id)
SELECT r.transaction_id, r.user_id, coalesce(r.goal_id, p.goal_id) AS goal_id FROM r LEFT JOIN pe p ON NOT r.pending AND r.link = p.transaction_id WHERE r.transaction_id NOT IN (SELECT transaction_id FROM go)""")
def _(tx):
    number = F.expr("try_cast(transaction_id AS BIGINT)")
    link = F.when(~F.col("pending") & (number % 20).between(1, 4), (number - number % 20).cast("string"))
    return settled(tx.select("transaction_id", "user_id", "goal_id", "pending", link.alias("pending_transaction_id")), own=("goal_id",))


@register("t08_adopted", "transaction_id s, plaid_transaction_id s", "tx", f"""
WITH r AS (SELECT transaction_id, user_id, account_id, floor(amount / 500) AS amount, date_trunc('month', transaction_date) AS d, 'x' AS description, {_FEED} AS feed FROM tx),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, account_id, amount, d, description, feed IS NOT NULL ORDER BY transaction_id) AS k FROM r),
m AS (SELECT a.transaction_id, b.transaction_id AS taken, coalesce(b.feed, a.feed) AS feed FROM n a LEFT JOIN n b ON b.feed IS NOT NULL AND a.user_id = b.user_id AND a.account_id = b.account_id AND a.amount = b.amount AND a.d = b.d AND a.k = b.k WHERE a.feed IS NULL)
SELECT transaction_id, feed AS plaid_transaction_id FROM m UNION ALL SELECT transaction_id, feed FROM n WHERE feed IS NOT NULL AND transaction_id NOT IN (SELECT taken FROM m WHERE taken IS NOT NULL)""")
def _(tx):
    """Rows of a month and amounts of 500 count as equal here, so that the given tables hold pairs."""
    feed = F.when((F.col("import_source") == "PLAID") & (F.col("plaid_transaction_id") != ""), F.col("plaid_transaction_id"))
    rows = tx.select("transaction_id", "user_id", "account_id", F.floor(F.col("amount") / 500).alias("amount"), F.date_trunc("month", "transaction_date").alias("transaction_date"), F.lit("x").alias("description"), feed.alias("plaid_transaction_id"))
    return adopted(rows)
