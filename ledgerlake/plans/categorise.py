"""Registered queries of operators.categorise."""

from pyspark.sql import functions as F

from ledgerlake.operators import categorise as C
from ledgerlake.operators import merchants as M
from ledgerlake.registry import register

_RULES = "ru(rule_id, keyword, cat, priority, lvl) AS (VALUES " + ", ".join(f"({i}, '{k}', '{c}', {p}, {s})" for i, (k, c, p, s) in enumerate(C.RULES)) + ")"
_MATCH = f"{_RULES}, mr AS (SELECT transaction_id, cat AS rule_category FROM tx JOIN ru ON contains(lower(concat_ws(' ', merchant_name, description)), keyword) QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY lvl, length(keyword) DESC, priority DESC, rule_id) = 1)"
_FEATURES = """fe AS (SELECT transaction_id, category_primary, unnest(list_concat(list_filter(['m:' || lower(merchant_name), 'a:' || CASE WHEN abs(amount) < 10 THEN 'tiny' WHEN abs(amount) < 50 THEN 'small' WHEN abs(amount) < 200 THEN 'medium' WHEN abs(amount) < 1000 THEN 'large' ELSE 'huge' END, 's:' || coalesce(import_source, 'none')], lambda x: x IS NOT NULL),
  list_transform(list_filter(regexp_split_to_array(lower(coalesce(description, '')), '\\s+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by')), lambda x: 'k:' || x))) AS feature FROM tx),
fc AS (SELECT feature, category_primary, count(*) AS n FROM fe WHERE category_primary IS NOT NULL GROUP BY 1, 2), fp AS (SELECT feature, category_primary, n / CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS p FROM fc)"""
_DIRECTORY = [("Merchant 1", "groceries", ["Corner Shop"]), ("Streamly", "streaming", []), ("Payrolls 12", "salary", []), ("Netflixx", "streaming", ["Merchant 2", "Merchant 33"]), ("Merchants 24", "shopping", [])]
_DIRECTORY_ROWS = ", ".join(f"('{n}', '{c}', {a}::VARCHAR[])" for n, c, a in _DIRECTORY)
_KEYS = f"""di(name, category, aliases) AS (VALUES {_DIRECTORY_ROWS}), dk AS (SELECT regexp_replace(lower(trim(n)), '[^a-z0-9]', '', 'g') AS key, al, name, category FROM (SELECT name AS n, 0 AS al, name, category FROM di UNION ALL SELECT unnest(aliases), 1, name, category FROM di)),
kn AS (SELECT key, al, arg_min(category, name) AS category FROM dk GROUP BY 1, 2), nm AS (SELECT DISTINCT merchant_name AS name, regexp_replace(lower(trim(merchant_name)), '[^a-z0-9]', '', 'g') AS key, regexp_split_to_array(trim(merchant_name), '[\\s\\-]+') AS w FROM tx WHERE trim(coalesce(merchant_name, '')) <> ''),
tr AS (SELECT name, 0 AS t, key AS asked FROM nm UNION ALL SELECT name, 1, regexp_replace(lower(w[1]), '[^a-z0-9]', '', 'g') FROM nm WHERE length(w[1]) >= 5 UNION ALL SELECT name, 2, regexp_replace(lower(w[1] || ' ' || w[2]), '[^a-z0-9]', '', 'g') FROM nm WHERE length(w[1]) >= 5 AND length(w[2]) >= 3),
ht AS (SELECT name, kn.category, CASE WHEN t > 0 THEN 'MERCHANT_DB_PREFIX' WHEN al = 1 THEN 'MERCHANT_DB_ALIAS' ELSE 'MERCHANT_DB_EXACT' END AS source, CASE WHEN t > 0 THEN 0.93::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM tr JOIN kn ON asked = key QUALIFY row_number() OVER (PARTITION BY name ORDER BY t, al) = 1),
fz AS (SELECT name, kn.category, kn.al, kn.key AS known, 1 - levenshtein(nm.key, kn.key) / CAST(greatest(length(nm.key), length(kn.key)) AS DOUBLE) AS sim FROM nm JOIN kn ON abs(length(nm.key) - length(kn.key)) <= 3 AND length(nm.key) >= 4 WHERE name NOT IN (SELECT name FROM ht)),
fb AS (SELECT name, category, 'MERCHANT_DB_FUZZY' AS source, round(0.90::DOUBLE + (sim - 0.85::DOUBLE) * 0.1::DOUBLE, 6) AS confidence FROM fz WHERE sim >= 0.85 QUALIFY row_number() OVER (PARTITION BY name ORDER BY al, sim DESC, known) = 1),
md AS (SELECT transaction_id, category, source, confidence FROM tx JOIN (SELECT * FROM ht UNION ALL SELECT * FROM fb) f ON f.name = merchant_name)"""


def _directory(spark):
    return spark.createDataFrame(_DIRECTORY, "name string, category string, aliases array<string>")


@register("c04_merchant_directory", "transaction_id s, category s, source s, confidence f", "tx", f"WITH {_KEYS} SELECT * FROM md")
def _(tx):
    return M.merchant_categories(tx, _directory(tx.sparkSession))


_CASCADE = f"""{_MATCH}, own AS (SELECT DISTINCT user_id, 'merchant ' || CAST(user_id AS VARCHAR) AS m, 'travel' AS own FROM preferences),
ca AS (SELECT t.transaction_id, t.user_id, CASE WHEN own IS NOT NULL THEN own WHEN lower(category_detailed) = 'interest charged' THEN 'interest' WHEN lower(category_detailed) IN ('insurance', 'dining') THEN lower(category_detailed) WHEN rule_category IS NOT NULL THEN rule_category ELSE coalesce(category_primary, 'other') END AS category,
  CASE WHEN own IS NOT NULL THEN 'USER' WHEN lower(category_detailed) IN ('interest charged', 'insurance', 'dining') THEN 'ISSUER' WHEN rule_category IS NOT NULL THEN 'RULE' WHEN category_primary IS NOT NULL THEN 'IMPORT' ELSE 'DEFAULT' END AS layer
  FROM tx t LEFT JOIN own ON own.user_id = t.user_id AND own.m = lower(t.merchant_name) LEFT JOIN mr ON mr.transaction_id = t.transaction_id)"""


@register("c05_match_rules", "transaction_id s, rule_category s", "tx", f"WITH {_MATCH} SELECT * FROM mr")
def _(tx):
    return C.match_rules(tx, C.rules_frame(tx.sparkSession))


def _corrections(preferences):
    return preferences.select("user_id", F.concat(F.lit("Merchant "), F.col("user_id").cast("string")).alias("merchant_name"), F.lit("travel").alias("category"))


@register("c12_cascade", "transaction_id s, user_id l, category s, layer s", "tx preferences", f"WITH {_CASCADE} SELECT * FROM ca")
def _(tx, preferences):
    return C.cascade(tx, _corrections(preferences), C.rules_frame(tx.sparkSession))


@register("c12_full_cascade", "transaction_id s, user_id l, category s, layer s, confidence f", "tx preferences", f"""
WITH {_CASCADE}, {_KEYS}, mc AS (SELECT transaction_id, 'travel' AS category FROM tx WHERE updated_at_ts % 97 = 0), {_FEATURES}, e AS (SELECT transaction_id, fp.category_primary, round(sum(CASE left(feature, 1) WHEN 'm' THEN 0.4::DOUBLE WHEN 'k' THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END * p), 9) AS score FROM fe JOIN fp USING (feature) GROUP BY 1, 2),
pr AS (SELECT transaction_id, category_primary AS predicted FROM e QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY score DESC, category_primary) = 1),
al AS (SELECT ca.*, mc.category AS code, md.category AS dir, md.confidence AS dir_sure, CASE tx.importer_category_primary WHEN 'FOOD_AND_DRINK' THEN 'dining' WHEN 'TRANSFER_OUT' THEN 'transfer' END AS feed, predicted FROM ca JOIN tx USING (transaction_id) LEFT JOIN mc USING (transaction_id) LEFT JOIN md USING (transaction_id) LEFT JOIN pr USING (transaction_id))
SELECT transaction_id, user_id, CASE WHEN layer = 'USER' THEN category WHEN code IS NOT NULL THEN code WHEN layer = 'ISSUER' THEN category WHEN dir IS NOT NULL THEN dir WHEN feed IS NOT NULL THEN feed WHEN layer = 'RULE' THEN category ELSE coalesce(predicted, category) END AS category,
  CASE WHEN layer = 'USER' THEN 'USER' WHEN code IS NOT NULL THEN 'MCC' WHEN layer = 'ISSUER' THEN 'ISSUER' WHEN dir IS NOT NULL THEN 'MERCHANT_DB' WHEN feed IS NOT NULL THEN 'TAXONOMY' WHEN layer = 'RULE' THEN 'RULE' WHEN predicted IS NOT NULL THEN 'ML' ELSE layer END AS layer,
  CASE WHEN layer = 'USER' THEN 1 WHEN code IS NOT NULL THEN 0.96 WHEN layer = 'ISSUER' THEN 0.92 WHEN dir IS NOT NULL THEN dir_sure WHEN feed IS NOT NULL THEN 0.90 WHEN layer = 'RULE' THEN 0.80 WHEN predicted IS NOT NULL THEN 0.75 WHEN layer = 'IMPORT' THEN 0.60 ELSE 0.10 END AS confidence FROM al""")
def _(tx, preferences):
    codes = tx.where("updated_at_ts % 97 = 0").select("transaction_id", F.lit("travel").alias("category"), F.lit(0.96).alias("confidence"))
    learned = C.score_frequencies(tx, C.learn_frequencies(tx))
    return C.cascade(tx, _corrections(preferences), C.rules_frame(tx.sparkSession), codes, M.merchant_categories(tx, _directory(tx.sparkSession)), {"FOOD_AND_DRINK": "dining", "TRANSFER_OUT": "transfer"}, None, learned)


@register("t10_review_queue", "transaction_id s, user_id l", "tx preferences", f"WITH {_CASCADE} SELECT transaction_id, user_id FROM ca WHERE layer IN ('RULE', 'IMPORT', 'DEFAULT')")
def _(tx, preferences):
    return C.review_queue(C.cascade(tx, _corrections(preferences), C.rules_frame(tx.sparkSession)), least=0.85)


@register("j16_aliases", "name s, canonical s", "tx", "SELECT DISTINCT lower(merchant_name) AS name, CASE WHEN starts_with(lower(merchant_name), 'streamly') THEN 'streamly' WHEN starts_with(lower(merchant_name), 'merchant 1') THEN 'merchant one' WHEN starts_with(lower(merchant_name), 'merchant 12') THEN 'twelve' ELSE lower(merchant_name) END AS canonical FROM tx WHERE merchant_name IS NOT NULL")
def _(tx):
    return C.account_aliases(tx, [("streamly", "streamly"), ("merchant 1", "merchant one"), ("merchant 12", "twelve")])


@register("c09_frequencies", "feature s, category_primary s, p f", "tx", f"WITH {_FEATURES} SELECT * FROM fp")
def _(tx):
    return C.learn_frequencies(tx)


@register("c09_predictions", "transaction_id s, predicted s, score f", "tx", f"""
WITH {_FEATURES}, e AS (SELECT transaction_id, fp.category_primary, round(sum(CASE left(feature, 1) WHEN 'm' THEN 0.4::DOUBLE WHEN 'k' THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END * p), 9) AS score FROM fe JOIN fp USING (feature) GROUP BY 1, 2)
SELECT transaction_id, category_primary AS predicted, score FROM e QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY score DESC, category_primary) = 1""")
def _(tx):
    return C.score_frequencies(tx, C.learn_frequencies(tx))


_TAX = """tc AS (SELECT *, lower(coalesce(description, '')) AS d, lower(coalesce(merchant_name, '')) AS m, lower(coalesce(category_primary, '')) AS c, lower(coalesce(payment_channel, '')) AS ch FROM tx),
tk AS (SELECT *, CASE WHEN amount > 0 AND regexp_matches(d, 'payroll|salary|paycheck|wages') THEN 'SALARY'
  WHEN amount > 0 AND regexp_matches(c || ' ' || d || ' ' || m, 'rsu|restricted stock|stock vest|equity vest') THEN 'RSU'
  WHEN contains(ch, 'ach') OR regexp_matches(d, 'ach|direct deposit|electronic transfer') THEN CASE WHEN amount > 0 THEN 'ACH_INCOME' ELSE 'ACH_EXPENSE' END
  WHEN contains(d, 'mortgage') AND contains(d, 'interest') THEN 'MORTGAGE_INTEREST' WHEN c = 'interest' OR contains(d, 'interest') THEN 'INTEREST' WHEN c = 'dividend' OR contains(d, 'dividend') THEN 'DIVIDEND'
  WHEN regexp_matches(d || ' ' || c, 'donation|charity|charitable|gofundme|red cross|tithe') THEN 'CHARITY'
  WHEN regexp_matches(d || ' ' || m, 'dmv|vehicle registration|license renewal|driver license') THEN 'DMV'
  WHEN regexp_matches(d || ' ' || m, 'cpa|tax preparer|tax preparation|h&r block|turbotax') THEN 'CPA'
  WHEN regexp_matches(d || ' ' || m || ' ' || c, 'tuition|university|school fee|education') THEN 'TUITION'
  WHEN regexp_matches(d || ' ' || m, 'property tax|real estate tax|tax assessor') THEN 'PROPERTY_TAX'
  WHEN regexp_matches(d || ' ' || m, 'state tax|state income tax|franchise tax board|ftb') THEN 'STATE_TAX'
  WHEN regexp_matches(d || ' ' || m, 'city tax|county tax|local tax|municipal tax') THEN 'LOCAL_TAX'
  WHEN c = 'healthcare' OR contains(d, 'medical') THEN 'MEDICAL'
  WHEN c = 'investment' OR regexp_matches(d, 'stock sale|capital gain') THEN CASE WHEN amount > 0 THEN 'CAPITAL_GAIN' ELSE 'CAPITAL_LOSS' END ELSE 'OTHER' END AS tax_class FROM tc)"""


@register("f33_tax_classes", "transaction_id s, tax_class s", "tx", f"WITH {_TAX} SELECT transaction_id, tax_class FROM tk")
def _(tx):
    return tx.select("transaction_id", C.tax_class().alias("tax_class"))


@register("a18_tax_summary", "user_id l, year l, tax_class s, total m, n l", "tx", f"""
WITH {_TAX} SELECT user_id, year(transaction_date) AS year, tax_class, sum(CASE WHEN tax_class IN ('CHARITY', 'DMV', 'CPA', 'TUITION', 'PROPERTY_TAX', 'STATE_TAX', 'LOCAL_TAX', 'MORTGAGE_INTEREST', 'MEDICAL') THEN abs(amount) WHEN tax_class NOT IN ('OTHER', 'ACH_INCOME', 'ACH_EXPENSE') THEN amount END) AS total, count(*) AS n
FROM tk WHERE year(transaction_date) BETWEEN 1998 AND 2001 GROUP BY GROUPING SETS ((user_id, year(transaction_date), tax_class), (user_id, tax_class))""")
def _(tx):
    return C.tax_summary(tx, 1998, 2001)


@register("f32_deductibility", "subscription_id s, deductible s", "subscriptions", """SELECT subscription_id, CASE
  WHEN regexp_matches(lower(merchant_name), 'adobe|microsoft 365|office 365|notion|figma|jetbrains|github|linkedin|linkedin premium|quickbooks|freshbooks|wave|calendly|zoom|slack|dropbox business|google workspace|1password|lastpass|expensify|shopify|stripe|mailchimp|intercom') THEN 'FULL'
  WHEN regexp_matches(lower(merchant_name), 'netflix|hulu|disney|hbo|max|paramount|peacock|apple tv|spotify|apple music|tidal|youtube music|amazon music|audible|peloton|apple fitness|strava|playstation plus|xbox game pass|nintendo switch online') THEN 'NONE'
  WHEN regexp_matches(lower(merchant_name), 'phone|internet|verizon|att|comcast|xfinity|icloud|google drive|google one|onedrive|dropbox') THEN 'PARTIAL' ELSE 'UNKNOWN' END AS deductible FROM subscriptions""")
def _(subscriptions):
    return subscriptions.select("subscription_id", C.deductibility(F.col("merchant_name")).alias("deductible"))


@register("j19_nearest_reference", "vec_id l, nearest l, similarity f", sql="""
WITH p AS (SELECT a.vec_id, b.vec_id AS nearest, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, nearest, round(s, 6) AS similarity FROM p WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nearest) = 1""")
def _(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return C.nearest_reference(vectors.where("vec_id % 100 = 0"), vectors, least=0.3)


@register("d08_unusualness", "vec_id l, unusual f", sql="""
WITH p AS (SELECT a.vec_id, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1) SELECT vec_id, round(1 - s, 6) AS unusual FROM p""")
def _(spark, sf_dir):
    return C.unusualness(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
