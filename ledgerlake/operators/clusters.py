"""A user's alike merchants under one head (row J17 inside D14): similarity by brand words or blended score, clusters first come, first served.

Names of one user meet only over a shared word. In the order of names each name that no head has taken is a head and takes all later ones
that are alike; a taken name draws no further ones. That is found in rounds over the table of alike pairs: a name without lesser neighbours is
a head, its neighbours are taken, both leave the table, and so on until it is empty; each round is one pass, and names far apart are
decided side by side. A taken name belongs to its least head.

Defined results: null and blank names are left out; repeated names count once; a name like none is a head of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.cleaning import clean_merchant, fuzzy_score
from ledgerlake.functions.text import normalized_merchant
from ledgerlake.sources.keyed import shared_folder

#: The blended score from which names are alike whose brand words don't show it.
LEAST = 0.90


def cut(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read back: it is computed once, and later plans begin there."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote and that no result needs any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def brand_words(name: Column) -> Column:
    """A name's words of three letters or more, without web endings."""
    words = F.transform(F.split(F.lower(normalized_merchant(name)), r"[\s/*]+"), lambda w: F.regexp_replace(w, r"\.(com|net|org|co)$", ""))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def _brand_key(word: Column) -> Column:
    """Words are alike if they are equal, or both have four letters or more and begin with the same four."""
    return F.when(F.length(word) >= 4, F.concat(F.substring(word, 1, 4), F.lit("*"))).otherwise(word)


def alike(names: DataFrame) -> DataFrame:
    """user_id, head, merchant: pairs of names(user_id, merchant), head < merchant, that are alike, each once. Written.

    Alike: two brand words in common, or one where either name has no other; or a blended score of LEAST, which implies a shared word.
    """
    one = names.where(F.trim(F.coalesce("merchant", F.lit(""))) != "").distinct()
    cleaned = F.filter(F.split(clean_merchant(F.col("merchant")), r"\s+"), lambda w: w != "")
    keyed = one.withColumn("brands", brand_words(F.col("merchant"))).withColumn("keys", F.transform("brands", _brand_key))
    words = F.array_distinct(F.concat(F.transform("keys", lambda k: F.concat(F.lit("b"), k)), F.transform(cleaned, lambda w: F.concat(F.lit("w"), w))))
    entries = keyed.select("user_id", "merchant", "keys", F.explode(words).alias("word"))
    left = entries.select("user_id", "word", F.col("merchant").alias("head"), F.col("keys").alias("head_keys"))
    pairs = left.join(entries, ["user_id", "word"]).where(F.col("head") < F.col("merchant")).select("user_id", "head", "merchant", "head_keys", "keys").distinct()
    common = F.size(F.filter("head_keys", lambda k: F.array_contains("keys", k)))
    by_brand = (common >= 2) | (common >= 1) & ((F.size("head_keys") <= 1) | (F.size("keys") <= 1))
    decided = cut(pairs.select("user_id", "head", "merchant", by_brand.alias("by_brand")))
    sure, open_pairs = (decided.where(c).select("user_id", "head", "merchant") for c in ("by_brand", "NOT by_brand"))
    if open_pairs.isEmpty():
        return sure
    a, b = clean_merchant(F.col("head")), clean_merchant(F.col("merchant"))
    close = open_pairs.select("head", "merchant").distinct().where(F.greatest(fuzzy_score(a, b), fuzzy_score(b, a)) >= LEAST)
    return cut(sure.unionByName(open_pairs.join(close, ["head", "merchant"], "left_semi").select("user_id", "head", "merchant")))


def heads(pairs: DataFrame) -> DataFrame:
    """user_id, merchant, cluster of the taken names of pairs(user_id, head, merchant): the least head that a name is alike to."""
    every = state = pairs  # read several times; of a round: pairs that are left, and heads found so far, which have no merchant
    while not (left := state.where("merchant IS NOT NULL")).isEmpty():
        lesser = left.select("user_id", F.col("merchant").alias("head")).distinct()
        first = left.select("user_id", "head").distinct().join(lesser, ["user_id", "head"], "left_anti")
        gone = left.join(first, ["user_id", "head"], "left_semi").select("user_id", F.col("merchant").alias("head")).distinct()
        rest = left.join(first.unionByName(gone), ["user_id", "head"], "left_anti").join(gone.withColumnRenamed("head", "merchant"), ["user_id", "merchant"], "left_anti")
        # A name that is left without pairs, and is no neighbour of a head, is a head: its lesser neighbours have all been taken.
        still = rest.select("user_id", "head").union(rest.select("user_id", "merchant"))
        free = lesser.join(gone.unionByName(still), ["user_id", "head"], "left_anti")
        found = state.where("merchant IS NULL").select("user_id", "head").unionByName(first).unionByName(free)
        before, state = state, cut(rest.select("user_id", "head", "merchant").unionByName(found.withColumn("merchant", F.lit(None).cast("string"))))
        if before is not every:
            discard(before)
    found = state.select("user_id", "head").distinct()
    mine = every.join(found, ["user_id", "head"], "left_semi").join(found.withColumnRenamed("head", "merchant"), ["user_id", "merchant"], "left_anti")
    return mine.groupBy("user_id", "merchant").agg(F.min("head").alias("cluster"))


def clusters(names: DataFrame) -> DataFrame:
    """user_id, merchant, cluster for each distinct name of names(user_id, merchant)."""
    one = names.where(F.trim(F.coalesce("merchant", F.lit(""))) != "").select("user_id", "merchant").distinct()
    return one.join(heads(alike(one)), ["user_id", "merchant"], "left").select("user_id", "merchant", F.coalesce("cluster", "merchant").alias("cluster"))
