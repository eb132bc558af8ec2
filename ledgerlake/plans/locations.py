"""Registered query of operators.locations: suppliers' shops in cities of one to three words, made of nations' names."""

from pyspark.sql import functions as F

from ledgerlake.operators.locations import locate
from ledgerlake.registry import register

_CODES = ("WA", "OR", "CA", "ON", "GBR")
_PREFIXES = ("", "Port ", "North Port ")


@register("f35_gazetteer", "description s, merchant s, city s, state s", sql=f"""
WITH g AS (SELECT n_nationkey, n_name, [{', '.join(f"'{c}'" for c in _CODES)}][n_nationkey % 5 + 1] AS state FROM nation),
d AS (SELECT 'Shop ' || s_suppkey % 50 AS shop, [{', '.join(f"'{p}'" for p in _PREFIXES)}][s_suppkey % 3 + 1] || CASE WHEN s_suppkey % 7 = 0 THEN upper(n_name) ELSE n_name END AS city, state FROM supplier JOIN g ON n_nationkey = s_nationkey)
SELECT DISTINCT shop || ' ' || city || ' ' || state AS description, shop AS merchant, city, state FROM d""")
def _(spark, sf_dir):
    one_of = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    places = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", one_of(_CODES, F.col("n_nationkey") % 5).alias("state"))
    cities = places.select(F.explode(F.array(*[F.concat(F.lit(p), "n_name") for p in _PREFIXES])).alias("city"), "state")
    shops = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(places, F.col("n_nationkey") == F.col("s_nationkey"))
    name = F.when(F.col("s_suppkey") % 7 == 0, F.upper("n_name")).otherwise(F.col("n_name"))
    city = F.concat(one_of(_PREFIXES, F.col("s_suppkey") % 3), name)
    return locate(shops.select(F.concat_ws(" ", F.concat(F.lit("Shop "), (F.col("s_suppkey") % 50).cast("string")), city, "state").alias("description")), cities)
