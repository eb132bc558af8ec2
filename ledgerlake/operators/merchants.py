"""A merchant directory as a frame, and the category layer that looks names up in it (row C04, S22).

directory(name, category, aliases: array of string) comes from a file (`read_directory`) or any table. Distinct names are looked up,
not rows: whole keys, then the first word, then the first two, canonical names before aliases; what is left is matched by
Levenshtein similarity, found by equality on pieces: of two texts within d edits one of d + 1 pieces is unchanged, at most d places away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import levenshtein_similarity, merchant_key

EXACT, PREFIX = 0.95, 0.93
#: Fuzzy names: the least similarity, the most that lengths differ, and what a similarity beyond the least adds to 0.90.
LEAST, MOST_LONGER, SLOPE = 0.85, 3, 0.1


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """A directory from JSON lines: {"name": ..., "category": ..., "aliases": [...]}."""
    return spark.read.schema("name string, category string, aliases array<string>").json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules for categorise.match_rules from CSV with a header: keyword, category, priority, source_level; numbered in order of these."""
    rows = spark.read.schema("keyword string, category string, priority int, source_level int").option("header", True).csv(path)
    rows = rows.where("keyword IS NOT NULL AND category IS NOT NULL")
    order = F.struct("source_level", "keyword", "category", "priority")
    return rows.select(F.xxhash64(order).alias("rule_id"), F.lower("keyword").alias("keyword"), F.col("category").alias("rule_category"), F.coalesce("priority", F.lit(0)).alias("priority"), F.coalesce("source_level", F.lit(2)).alias("source_level"))


def keys(directory: DataFrame) -> DataFrame:
    """key, is_alias -> category: one row each; of equal keys the first name's."""
    named = directory.where("name IS NOT NULL AND category IS NOT NULL")
    own = named.select(merchant_key(F.col("name")).alias("key"), F.lit(0).alias("is_alias"), "name", "category")
    other = named.select(F.explode("aliases").alias("alias"), "name", "category").select(merchant_key(F.col("alias")).alias("key"), F.lit(1).alias("is_alias"), "name", "category")
    return own.unionByName(other).where("key <> ''").groupBy("key", "is_alias").agg(F.min_by("category", "name").alias("category"))


def _edits(length: Column) -> Column:
    """Edits that a similarity of LEAST allows where the longer text has `length` letters."""
    return F.floor((1 - LEAST) * length + 1e-9).cast("int")


def _pieces(text: Column, length: Column, reach: Column | None = None) -> Column:
    """(length, piece, letters): a text cut as one of `length` letters is; with reach, at every place up to so many letters away."""
    n = _edits(length + MOST_LONGER) + 1
    start = lambda i: F.floor(i * length / n).cast("int")

    def at(i: Column) -> Column:
        size = start(i + 1) - start(i)
        shifts = F.array(F.lit(0)) if reach is None else F.sequence(-reach, reach)
        return F.transform(F.filter(shifts, lambda s: start(i) + s >= 0), lambda s: F.struct(length.alias("length"), i.alias("piece"), F.substring(text, start(i) + s + 1, size).alias("letters")))

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at))


def fuzzy(names: DataFrame, known: DataFrame) -> DataFrame:
    """names(name, key) -> name, is_alias, category, similarity: the most similar canonical key, or the most similar alias if none is."""
    long = F.length("key")
    mine = known.select(F.col("key").alias("known"), "is_alias", "category", F.explode(_pieces(F.col("key"), long)).alias("p")).select("known", "is_alias", "category", "p.*")
    lengths = F.sequence(F.greatest(F.lit(4), long - MOST_LONGER), long + MOST_LONGER)
    asked = names.where(long >= 4).withColumn("length", F.explode(lengths)).withColumn("p", F.explode(F.array_distinct(_pieces(F.col("key"), F.col("length"), _edits(F.greatest(long, F.col("length"))))))).select("name", "key", "p.*")
    pairs = asked.join(mine, ["length", "piece", "letters"]).select("name", "key", "known", "is_alias", "category").distinct()
    near = pairs.withColumn("similarity", levenshtein_similarity(F.col("key"), F.col("known"))).where(F.col("similarity") >= LEAST)
    best = near.groupBy("name").agg(F.min(F.struct("is_alias", (-F.col("similarity")).alias("far"), "known", "category")).alias("best"))
    return best.select("name", "best.is_alias", "best.category", (-F.col("best.far")).alias("similarity"))


def merchant_categories(tx: DataFrame, directory: DataFrame) -> DataFrame:
    """transaction_id -> category, source and confidence by the merchant's name; rows whose merchant is not found are left out."""
    known = keys(directory)
    trimmed = F.trim("merchant_name")
    names = tx.where(F.coalesce(trimmed, F.lit("")) != "").select(F.col("merchant_name").alias("name")).distinct().withColumn("key", merchant_key(F.col("name")))
    words = F.split(F.trim("name"), r"[\s\-]+")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    tries = F.array(
        F.struct(F.lit(0).alias("try"), F.col("key").alias("asked")),
        F.when(F.length(first) >= 5, F.struct(F.lit(1).alias("try"), merchant_key(first).alias("asked"))),
        F.when((F.length(first) >= 5) & (F.length(second) >= 3), F.struct(F.lit(2).alias("try"), merchant_key(F.concat_ws(" ", first, second)).alias("asked"))),
    )
    asked = names.select("name", F.explode(F.filter(tries, lambda t: t.isNotNull())).alias("t")).select("name", "t.*")
    hits = asked.join(known, F.col("asked") == F.col("key")).groupBy("name").agg(F.min(F.struct("try", "is_alias", "category")).alias("b"))
    source = F.when(F.col("b.try") > 0, "MERCHANT_DB_PREFIX").when(F.col("b.is_alias") == 1, "MERCHANT_DB_ALIAS").otherwise("MERCHANT_DB_EXACT")
    hits = hits.select("name", "b.category", source.alias("source"), F.when(F.col("b.try") > 0, PREFIX).otherwise(EXACT).alias("confidence"))
    rest = fuzzy(names.join(hits, "name", "left_anti"), known)
    rest = rest.select("name", "category", F.lit("MERCHANT_DB_FUZZY").alias("source"), F.round(0.90 + (F.col("similarity") - LEAST) * SLOPE, 6).alias("confidence"))
    return tx.select("transaction_id", F.col("merchant_name").alias("name")).join(hits.unionByName(rest), "name").select("transaction_id", "category", "source", "confidence")
