"""Merchants and places of texts like "NAME CITY ST" by a gazetteer (row F35): the longest known city before the state counts.

gazetteer(city, state) is a file (`read_gazetteer`) or any table; its state may be any code that stands last: a state, a province, a country. Distinct texts
are cut into all endings of up to as many words as the longest city has; an ending that is a city of the text's last word is found by equality, so
cities of any number of words cost one join. Where no city is known, one word before a state of the United States is taken for it, as
functions.masking.split_location does; that needs no gazetteer.

Defined results: null texts have null parts; a text needs a word before its city to have a place, else all of it is the merchant; case and runs of blanks don't
matter for the search, and parts are given as the text has them, with single blanks; equal texts are looked up once; repeated entries of the gazetteer count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.masking import split_location


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """city, state from CSV with a header."""
    return spark.read.schema("city string, state string").option("header", True).csv(path)


def locate(rows: DataFrame, gazetteer: DataFrame, column: str = "description") -> DataFrame:
    """`column`, merchant, city, state of each distinct text of rows."""
    lower = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    known = gazetteer.select(lower(F.col("city")).alias("of_city"), lower(F.col("state")).alias("of_state")).where("of_city <> '' AND of_state <> ''").distinct()
    longest = known.agg(F.max(F.size(F.split("of_city", " ")))).first()[0] or 0
    texts = rows.select(F.col(column).alias("text")).distinct().withColumn("words", F.split(F.trim("text"), r"\s+"))
    n = F.size("words")
    if longest:
        sizes = F.sequence(F.lit(1), F.least(F.lit(longest), n - 2))
        endings = texts.where(n >= 3).select("text", "words", F.explode(sizes).alias("size"))
        part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
        asked = endings.select("text", "size", part(F.size("words") - F.col("size"), F.col("size")).alias("city"), F.element_at("words", -1).alias("state"), part(F.lit(1), F.size("words") - F.col("size") - 1).alias("merchant"))
        hits = asked.join(known, (F.lower("city") == F.col("of_city")) & (F.lower("state") == F.col("of_state")))
        best = hits.groupBy("text").agg(F.max_by(F.struct("merchant", "city", "state"), "size").alias("found"))
        texts = texts.join(best, "text", "left")
    else:
        texts = texts.withColumn("found", F.lit(None).cast("struct<merchant:string,city:string,state:string>"))
    place = F.when(F.col("found").isNull(), split_location(F.col("text"))).otherwise(F.col("found"))
    return texts.withColumn("place", place).select(F.col("text").alias(column), "place.merchant", "place.city", "place.state")
