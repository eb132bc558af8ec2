"""Registered queries of sources and imports."""

from pyspark.sql import functions as F

from ledgerlake.functions import cleaning as K
from ledgerlake.functions import text as X
from ledgerlake.operators import imports as I
from ledgerlake.registry import register
from ledgerlake.sources import files, tables

_DEDUP = """one AS (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date, updated_at_ts) = 1),
ded AS (SELECT * FROM one WHERE plaid_transaction_id IS NULL OR plaid_transaction_id = '' UNION ALL SELECT * FROM one WHERE plaid_transaction_id <> '' QUALIFY row_number() OVER (PARTITION BY plaid_transaction_id ORDER BY transaction_date, transaction_id) = 1)"""
_ROW = "transaction_id s, user_id l, amount m, transaction_date d"


_IN_RANGE = _DEDUP.replace("FROM tx", "FROM (SELECT * FROM tx WHERE transaction_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31')")


@register("s01_user_range", _ROW, "tx", f"WITH {_IN_RANGE} SELECT * FROM ded")
def _(tx):
    return tables.user_range(tx, "1999-01-01", "2000-12-31")


@register("s03_user_page", _ROW + ", place l", "tx", f"WITH {_DEDUP}, pl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY transaction_date DESC, transaction_id DESC) AS place FROM ded) SELECT * FROM pl WHERE place BETWEEN 21 AND 70")
def _(tx):
    return tables.user_page(tx, 20)


@register("s05_by_goal", _ROW + ", goal_id s", "tx goals", "SELECT * FROM tx WHERE EXISTS (SELECT 1 FROM goals g WHERE g.user_id = tx.user_id AND g.goal_id = tx.goal_id AND NOT g.completed)")
def _(tx, goals):
    return tables.by_goals(tx, goals.where("NOT completed"))


@register("s06_updated_since", _ROW, "tx", "SELECT * FROM tx WHERE updated_at_ts >= 1014000")
def _(tx):
    return tables.updated_since(tx, 1_014_000)


@register("s07_by_ids", _ROW, "tx feedback", "SELECT * FROM tx WHERE transaction_id IN (SELECT transaction_id FROM feedback WHERE verdict = 'CONFIRMED')")
def _(tx, feedback):
    return tables.by_ids(tx, feedback.where("verdict = 'CONFIRMED'").select("transaction_id"))


@register("s08_composite_matches", "wanted_id s, transaction_id s", "tx", "SELECT w.transaction_id AS wanted_id, t.transaction_id FROM tx w JOIN tx t ON t.account_id = w.account_id AND t.amount = w.amount AND t.transaction_date = w.transaction_date AND (t.description = w.description OR t.merchant_name = w.description) WHERE w.import_source = 'CSV'")
def _(tx):
    return tables.composite_matches(tx, tx.where("import_source = 'CSV'"))


@register("s09_deduplicated", _ROW, "tx", f"WITH {_DEDUP} SELECT * FROM ded")
def _(tx):
    return tables.deduplicated(tx)


@register("s12_reminders", "action_id s, user_id l, due_date d", "actions", "SELECT * FROM actions WHERE due_date BETWEEN DATE '2001-07-20' AND DATE '2001-08-10'")
def _(actions):
    return actions.where("due_date BETWEEN DATE '2001-07-20' AND DATE '2001-08-10'")


@register("s23_sync_status", "frame s, n l, cursor l", "tx accounts budgets", "SELECT 'tx' AS frame, count(*) AS n, max(updated_at_ts) AS cursor FROM tx UNION ALL SELECT 'accounts', count(*), NULL FROM accounts UNION ALL SELECT 'budgets', count(*), NULL FROM budgets")
def _(tx, accounts, budgets):
    return tables.sync_status(tx=tx, accounts=accounts, budgets=budgets)


@register("p08_search", _ROW, "tx", "SELECT * FROM tx WHERE NOT deleted AND transaction_date BETWEEN DATE '2000-01-01' AND DATE '2001-08-01' AND category_primary = 'dining' AND contains(lower(merchant_name), 'chant 1')")
def _(tx):
    return tables.search(tx, "2000-01-01", "2001-08-01", "dining", "CHANT 1")


_TEXT = "regexp_replace(trim(lower(coalesce(description, ''))), '\\s+', ' ', 'g')"
_LIKE = "CASE WHEN {0} = {1} THEN 1::DOUBLE WHEN {0} = '' OR {1} = '' THEN 0::DOUBLE ELSE 1 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE) END"


_FOUND = f"""WITH b AS (SELECT *, {_TEXT} AS txt, trim(lower(coalesce(merchant_name, ''))) AS nm FROM tx), w AS (SELECT user_id, min(transaction_date) - 35 AS lo, max(transaction_date) + 35 AS hi FROM b WHERE import_source = 'CSV' GROUP BY 1),
p AS (SELECT n.transaction_id AS new_id, k.transaction_id AS known_id, n.amount AS na, k.amount AS ka, n.txt AS nt, k.txt AS kt, n.nm AS nn, k.nm AS kn, abs(n.transaction_date - k.transaction_date) AS days, coalesce(n.plaid_transaction_id = k.plaid_transaction_id, FALSE) AS same_id
  FROM b n JOIN b k ON n.user_id = k.user_id AND n.transaction_id <> k.transaction_id JOIN w ON w.user_id = k.user_id AND k.transaction_date BETWEEN lo AND hi WHERE n.import_source = 'CSV' AND coalesce(k.import_source, '') <> 'CSV'),
q AS (SELECT *, days = 0 AND abs(na) = abs(ka) AND nt = kt AS exact, abs(na) = abs(ka) AND nt = kt AND (days BETWEEN 1 AND 60 OR days BETWEEN 88 AND 93 OR days BETWEEN 180 AND 186 OR days BETWEEN 365 AND 366) AS recurring, abs(CAST(round(CAST(na + ka AS DOUBLE) / 2, 2) AS DECIMAL(19,2))) AS mean FROM p WHERE same_id OR days <= 30),
o AS (SELECT *, CASE WHEN mean <> 0 THEN round(CAST(abs(na - ka) AS DOUBLE) / CAST(mean AS DOUBLE), 4) END AS off FROM q),
s AS (SELECT *, {_LIKE.format('nt', 'kt')} AS ts, CASE WHEN nn <> '' AND kn <> '' THEN ({_LIKE.format('nn', 'kn')}) * 0.2::DOUBLE ELSE 0::DOUBLE END AS ns,
  CASE WHEN (na >= 0) <> (ka >= 0) THEN 0.3::DOUBLE WHEN mean = 0 THEN CASE WHEN na = ka THEN 1::DOUBLE ELSE 0::DOUBLE END WHEN off < 0.001 THEN 1::DOUBLE WHEN off < 0.005 THEN 0.9::DOUBLE WHEN off < 0.01 THEN 0.7::DOUBLE WHEN off < 0.05 THEN 0.5::DOUBLE ELSE greatest(0::DOUBLE, 1 - off) END AS am,
  CASE WHEN days = 0 THEN 1::DOUBLE WHEN days <= 1 THEN 0.9::DOUBLE WHEN days <= 3 THEN 0.8::DOUBLE WHEN days <= 7 THEN 0.5::DOUBLE WHEN days <= 30 THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS dt FROM o),
r AS (SELECT *, CASE WHEN exact OR same_id THEN 1::DOUBLE WHEN recurring THEN 0.3::DOUBLE ELSE least(1::DOUBLE, am * 0.3::DOUBLE + dt * 0.2::DOUBLE + CASE WHEN ts >= 0.95 THEN ts * 0.3::DOUBLE WHEN ts >= 0.5 THEN ts * 0.05::DOUBLE ELSE ts * 0.01::DOUBLE END + ns) END AS sc FROM s),
f AS (SELECT new_id, known_id, CASE WHEN exact THEN 'EXACT' WHEN same_id THEN 'SAME_ID' WHEN sc >= 0.85 THEN 'SIMILAR' END AS kind, round(sc, 4) AS score FROM r)"""


@register("o07_ranked_matches", "new_id s, place l, known_id s, kind s, score f", "tx", f"{_FOUND} SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, kind, known_id) AS place FROM f WHERE kind IS NOT NULL")
def _(tx):
    return I.matches(tx.where("import_source = 'CSV'"), tx.where("coalesce(import_source, '') <> 'CSV'"), least=0.85)


@register("x13_duplicates", "new_id s, known_id s, kind s, score f", "tx", f"{_FOUND} SELECT * FROM f WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY score DESC, kind, known_id) = 1")
def _(tx):
    return I.duplicates(tx.where("import_source = 'CSV'"), tx.where("coalesce(import_source, '') <> 'CSV'"), least=0.85)


@register("f02_normalized_merchants", "description s, merchant s", "tx", r"""
SELECT DISTINCT description, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(description)), '^(ACH|PPD|POS|WEB|DEBIT|PURCHASE)\s+', ' ', 'g'), '\.COM\b', ' ', 'g'), '\b(INC|LLC|CORP|LTD)\b\.?', ' ', 'g'), '#\s*\d+', ' ', 'g'), '\b\d{4,}\b', ' ', 'g'), '\*', ' ', 'g'), '\s+', ' ', 'g')) AS merchant FROM tx""")
def _(tx):
    return tx.select("description", X.normalized_merchant(F.col("description")).alias("merchant")).distinct()


@register("f07_merchant_similarity", "a s, b s, similarity f, jaccard f", "tx subscriptions", """
WITH a AS (SELECT DISTINCT merchant_name AS a FROM tx WHERE merchant_name IS NOT NULL), b AS (SELECT DISTINCT merchant_name AS b FROM subscriptions)
SELECT a, b, round(1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 6) AS similarity, round(len(list_intersect(list_distinct(string_split(lower(a), ' ')), list_distinct(string_split(lower(b), ' ')))) / CAST(len(list_distinct(list_concat(string_split(lower(a), ' '), string_split(lower(b), ' ')))) AS DOUBLE), 6) AS jaccard FROM a CROSS JOIN b""")
def _(tx, subscriptions):
    a, b = tx.where("merchant_name IS NOT NULL").select(F.col("merchant_name").alias("a")).distinct(), subscriptions.select(F.col("merchant_name").alias("b")).distinct()
    return a.crossJoin(b).select("a", "b", F.round(X.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(X.token_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@register("f08_jaro_winkler", "a s, b s, similarity f", "tx subscriptions", """
WITH a AS (SELECT DISTINCT merchant_name AS a FROM tx WHERE merchant_name IS NOT NULL), b AS (SELECT DISTINCT merchant_name AS b FROM subscriptions) SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM a CROSS JOIN b""")
def _(tx, subscriptions):
    a, b = tx.where("merchant_name IS NOT NULL").select(F.col("merchant_name").alias("a")).distinct(), subscriptions.select(F.col("merchant_name").alias("b")).distinct()
    return a.crossJoin(b).select("a", "b", F.round(X.jaro_winkler_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@register("f38_statement_check", "account_id l, result s", "accounts", """
SELECT account_id, CASE WHEN credit_limit IS NULL THEN 'SKIPPED' WHEN abs(balance - abs(past_due_amount) + coalesce(annual_fee, 0) - (balance - CASE WHEN account_id % 2 = 0 THEN past_due_amount ELSE 0 END)) <= 1 THEN 'PASS' ELSE 'FAIL' END AS result FROM accounts""")
def _(accounts):
    new = F.when(F.col("credit_limit").isNotNull(), F.col("balance") - F.when(F.col("account_id") % 2 == 0, F.col("past_due_amount")).otherwise(0))
    return accounts.select("account_id", files.statement_check(F.col("balance"), F.col("past_due_amount"), F.lit(None), F.col("annual_fee"), F.lit(None), new).alias("result"))


def _cleaned(c: str) -> str:
    out = f"trim(lower(coalesce({c}, '')))"
    for pattern, new in K.CLEANING:
        out = f"trim(regexp_replace({out}, '{pattern}', '{new}', 'g'))"
    return out


@register("f06_clean_merchants", "description s, merchant s", "tx", f"SELECT DISTINCT description, {_cleaned('description')} AS merchant FROM tx")
def _(tx):
    return tx.select("description", K.clean_merchant(F.col("description")).alias("merchant")).distinct()


_STEM = "CASE WHEN length({0}) <= 3 THEN {0} WHEN {0} LIKE '%ies' AND length({0}) > 4 THEN {0}[:-4] || 'y' WHEN {0} LIKE '%ing' AND length({0}) > 5 THEN {0}[:-4] WHEN {0} LIKE '%ers' AND length({0}) > 5 THEN {0}[:-3] WHEN {0} LIKE '%es' AND length({0}) > 4 THEN {0}[:-3] WHEN {0} LIKE '%ed' AND length({0}) > 4 THEN {0}[:-3] WHEN {0} LIKE '%er' AND length({0}) > 4 THEN {0}[:-3] WHEN {0} LIKE '%s' AND NOT {0} LIKE '%ss' THEN {0}[:-2] ELSE {0} END"
_SYNONYM_ROWS = ", ".join(f"('{w}', '{head}')" for head, words in K.SYNONYMS.items() for w in (head, *words))


@register("f06_expanded_words", "description s, words s", "tx", f"""
WITH sy(w, head) AS (VALUES {_SYNONYM_ROWS}), d AS (SELECT DISTINCT description FROM tx), t AS (SELECT description, unnest(regexp_split_to_array(lower(description), '\\s+')) AS w FROM d),
k AS (SELECT * FROM t WHERE w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in K.STOP_WORDS)})), b AS (SELECT description, w FROM k UNION SELECT description, {_STEM.format("w")} FROM k), e AS (SELECT description, w FROM b UNION SELECT description, head FROM b JOIN sy USING (w))
SELECT description, string_agg(w, ' ' ORDER BY w) AS words FROM e GROUP BY 1""")
def _(tx):
    return tx.select("description").distinct().select("description", F.array_join(K.expanded_words(F.col("description")), " ").alias("words"))


@register("f05_pattern_keys", "transaction_id s, pattern s", "tx", """SELECT transaction_id, CASE WHEN trim(coalesce(merchant_name, '')) <> '' THEN lower(trim(merchant_name)) WHEN trim(coalesce(description, '')) <> '' THEN substring(trim(regexp_replace(regexp_replace(lower(trim(description)), '\\b\\d+\\b', '', 'g'), '\\s+', ' ', 'g')), 1, 30) END AS pattern FROM tx""")
def _(tx):
    return tx.select("transaction_id", K.pattern_key(F.col("merchant_name"), F.col("description")).alias("pattern"))


@register("f10_containment", "a s, b s, inside f, shared f", "tx subscriptions", """
WITH a AS (SELECT DISTINCT lower(description) AS a FROM tx), b AS (SELECT DISTINCT lower(merchant_name) AS b FROM subscriptions), p AS (SELECT a, b, regexp_split_to_array(a, '\\s+') AS wa, list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> '') AS wb, ' ' || regexp_replace(a, '[^a-z0-9]+', ' ', 'g') || ' ' AS pad FROM a CROSS JOIN b),
h AS (SELECT *, len(list_filter(wb, lambda w: list_contains(wa, w) OR (length(w) >= 5 AND contains(pad, ' ' || w || ' ')))) / CAST(len(wb) AS DOUBLE) AS share, list_intersect(list_distinct(wa), list_distinct(wb)) AS same, CAST(len(list_distinct(list_concat(wa, wb))) AS DOUBLE) AS n FROM p)
SELECT a, b, round(CASE WHEN contains(a, b) THEN least(1, 0.95 + length(b) / CAST(length(a) AS DOUBLE) * 0.05) WHEN share > 0 THEN CASE WHEN share >= 0.5 THEN share * 0.8 ELSE share * 0.3 END WHEN contains(b, a) THEN least(1, 0.9 + length(a) / CAST(length(b) AS DOUBLE) * 0.1) ELSE 0 END, 6) AS inside,
  round(least(1, len(same) / n + CASE WHEN len(same) > 0 THEN least(0.2, list_avg(list_transform(same, lambda w: length(w))) / 20) ELSE 0 END), 6) AS shared FROM h""")
def _(tx, subscriptions):
    a = tx.select(F.lower("description").alias("a")).distinct()
    b = subscriptions.select(F.lower("merchant_name").alias("b")).distinct()
    return a.crossJoin(b).select("a", "b", F.round(K.contained(F.col("a"), F.col("b")), 6).alias("inside"), F.round(K.boosted_jaccard(F.col("a"), F.col("b")), 6).alias("shared"))


@register("f09_fuzzy_scores", "a s, b s, score f", "tx subscriptions")
def _(tx, subscriptions):
    a = tx.where("merchant_name IS NOT NULL").select(K.clean_merchant(F.col("merchant_name")).alias("a")).distinct()
    b = subscriptions.select(K.clean_merchant(F.col("merchant_name")).alias("b")).distinct()
    return a.crossJoin(b).select("a", "b", F.round(K.fuzzy_score(F.col("a"), F.col("b")), 6).alias("score"))


@register("f42_multipliers", "transaction_id s, multiplier f", "tx", "SELECT transaction_id, CASE category_primary WHEN 'dining' THEN 3::DOUBLE WHEN 'travel' THEN 2::DOUBLE ELSE 1.5::DOUBLE END AS multiplier FROM tx")
def _(tx):
    return tx.select("transaction_id", K.lookup({"dining": 3.0, "travel": 2.0, "default": 1.5}, F.col("category_primary")).alias("multiplier"))
