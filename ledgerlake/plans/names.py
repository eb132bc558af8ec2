"""Registered queries of operators.names: product names, those of ids divisible by 100 against all; merchants against subscriptions; the cascade."""

from pyspark.sql import functions as F

from ledgerlake.operators import categorise as C
from ledgerlake.operators import merchants as M
from ledgerlake.operators import names as N
from ledgerlake.plans.categorise import _CASCADE, _corrections, _directory, _DIRECTORY
from ledgerlake.registry import register

#: The blended score of all pairs p(a, b), as fz(a, b, score).
SCORES = """
pw AS (SELECT a, b, list_sort(list_distinct(list_filter(regexp_split_to_array(a, '\\s+'), lambda w: w <> ''))) AS x, list_sort(list_distinct(list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> ''))) AS y, regexp_split_to_array(a, '\\s+') AS wa, list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> '') AS wb, ' ' || regexp_replace(a, '[^a-z0-9]+', ' ', 'g') || ' ' AS pad FROM p),
wp AS (SELECT a, b, w, unnest(y) AS o FROM (SELECT a, b, y, unnest(x) AS w FROM pw)),
wj AS (SELECT a, b, w, o, jaro_winkler_similarity(w, o) AS j FROM wp QUALIFY row_number() OVER (PARTITION BY a, b, w ORDER BY jaro_winkler_similarity(w, o) DESC, o) = 1),
wt AS (SELECT a, b, count(*) FILTER (j >= 0.7) AS n, sum(j ORDER BY w) FILTER (j >= 0.7) AS likeness, list_distinct(list_concat(list(w) FILTER (j >= 0.7), list(o) FILTER (j >= 0.7))) AS matched FROM wj GROUP BY a, b),
wu AS (SELECT pw.*, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN len(x) = len(y) AND len(matched) = len(list_distinct(list_concat(x, y))) AND n = len(x) THEN 1 ELSE least(1, len(matched) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) * 0.6 + likeness / n * 0.4) END AS tokens,
  list_intersect(x, y) AS same, len(list_distinct(list_concat(x, y))) AS every, jaro_winkler_similarity(pw.a, pw.b) AS jw,
  len(list_filter(wb, lambda w: list_contains(wa, w) OR (length(w) >= 5 AND contains(pad, ' ' || w || ' ')))) / CAST(len(wb) AS DOUBLE) AS share FROM pw LEFT JOIN wt ON pw.a = wt.a AND pw.b = wt.b),
wi AS (SELECT *, CASE WHEN contains(a, b) THEN least(1, 0.95 + length(b) / CAST(length(a) AS DOUBLE) * 0.05) WHEN share > 0 THEN CASE WHEN share >= 0.5 THEN share * 0.8 ELSE share * 0.3 END WHEN contains(b, a) THEN least(1, 0.9 + length(a) / CAST(length(b) AS DOUBLE) * 0.1) ELSE 0 END AS inside,
  least(1, len(same) / CAST(every AS DOUBLE) + CASE WHEN len(same) > 0 THEN least(0.2, list_avg(list_transform(same, lambda w: length(w))) / 20) ELSE 0 END) AS shared FROM wu),
fz AS (SELECT a, b, round(CASE WHEN jw < 0.3 THEN 0.2 * jw + 0.3 * tokens + 0.3 * inside + 0.2 * shared ELSE 0.3 * jw + 0.35 * tokens + 0.2 * inside + 0.15 * shared END, 6) AS score FROM wi)"""

_PARTS = "pn AS (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS n FROM part), p AS (SELECT DISTINCT q.n AS a, k.n AS b FROM pn q CROSS JOIN pn k WHERE q.p_partkey % 100 = 0)"


def _part_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("n"))


# Without SQL; a test holds it against all pairs.
@register("c08_near_names", "name s, known s, score f")
def _(spark, sf_dir):
    parts = _part_names(spark, sf_dir)
    return N.near_names(parts.where("p_partkey % 100 = 0"), parts, 0.75, "n", "n")


@register("c08_nearest_names", "name s, known s, score f", sql=f"WITH {_PARTS}, {SCORES} SELECT a AS name, b AS known, score FROM fz WHERE score >= 0.75 AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1")
def _(spark, sf_dir):
    parts = _part_names(spark, sf_dir)
    near = N.near_names(parts.where("p_partkey % 100 = 0"), parts, 0.75, "n", "n").where("name <> known")
    return near.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("far"), "known")).alias("b")).select("name", "b.known", (-F.col("b.far")).alias("score"))


_KNOWN = ", ".join(f"('{n.lower()}', '{c}')" for n, c, _ in _DIRECTORY)


@register("c08_cascade", "transaction_id s, user_id l, category s, layer s, confidence f", "tx preferences", f"""
WITH {_CASCADE}, kn(b, known_category) AS (VALUES {_KNOWN}), p AS (SELECT DISTINCT lower(merchant_name) AS a, b FROM tx CROSS JOIN kn WHERE trim(coalesce(merchant_name, '')) <> ''), {SCORES},
nb AS (SELECT a, known_category FROM fz JOIN kn USING (b) WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)
SELECT ca.transaction_id, ca.user_id, CASE WHEN layer IN ('IMPORT', 'DEFAULT') AND known_category IS NOT NULL THEN known_category ELSE category END AS category, CASE WHEN layer IN ('IMPORT', 'DEFAULT') AND known_category IS NOT NULL THEN 'ML_FUZZY' ELSE layer END AS layer,
  CASE WHEN layer IN ('IMPORT', 'DEFAULT') AND known_category IS NOT NULL THEN 0.75 ELSE CASE layer WHEN 'USER' THEN 1 WHEN 'ISSUER' THEN 0.92 WHEN 'RULE' THEN 0.80 WHEN 'IMPORT' THEN 0.60 ELSE 0.10 END END AS confidence
FROM ca JOIN tx USING (transaction_id) LEFT JOIN nb ON a = lower(merchant_name)""")
def _(tx, preferences):
    named = tx.withColumn("name", F.lower("merchant_name"))
    known = _directory(tx.sparkSession).select(F.lower("name").alias("known"), F.col("category"))
    near = N.nearest_names(named, known).join(known, "known")
    fuzzy = named.select("transaction_id", "name").join(near, "name").select("transaction_id", "category", F.lit(0.75).alias("confidence"))
    return C.cascade(tx, _corrections(preferences), C.rules_frame(tx.sparkSession), fuzzy=fuzzy)
