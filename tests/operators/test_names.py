import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import text
from ledgerlake.functions.cleaning import fuzzy_score
from ledgerlake.operators import names


def all_pairs(spark, a, b, least):
    x, y = (spark.createDataFrame([(n,) for n in sorted({n for n in s if n and n.strip()})], f"{c} string") for s, c in ((a, "name"), (b, "known")))
    pairs = x.crossJoin(y).select("name", "known", F.round(fuzzy_score(F.col("name"), F.col("known")), 6).alias("score"))
    return {tuple(r) for r in pairs.where(F.col("score") >= least).collect()}


def some_names(rng, n):
    words = ["corner", "cafe", "open", "openai", "store", "shop", "the", "market", "a", "io", "x", "grand", "central", "coffee", "roasters", "hill", "co", "12"]
    out = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(1, 5))) for _ in range(n)]
    out += ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(n // 4)]
    out += [f"{x}*{y}-{z}" for x, y, z in zip(rng.choices(words, k=20), rng.choices(words, k=20), rng.choices(words, k=20))]
    return out + [o[:-1] for o in out[:20]] + [o + "s" for o in out[20:40]] + ["corner cafe corner corner corner", "café 12", " padded  name "]


@pytest.mark.parametrize("least", [0.68, 0.75, 0.9])
def test_near_names_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    a, b = some_names(rng, 100), some_names(rng, 120)
    left, right = (spark.createDataFrame([(n,) for n in [*s, None, "", "  "]], f"{c} string") for s, c in ((a, "name"), (b, "known")))
    got = {tuple(r) for r in names.near_names(left, right, least).collect()}
    want = all_pairs(spark, a, b, least)
    assert got == want and len(got) > 20
    best = {}
    for n, k, s in sorted(want, key=lambda r: (r[0], -r[2], r[1])):
        best.setdefault(n, (k, s))
    assert {r.name: (r.known, r.score) for r in names.nearest_names(left, right, least).collect()} == best


def test_a_frequent_word_makes_no_pairs_by_itself(spark):
    """Names that share one of four words only: no candidates, though a word is in all of them."""
    left = spark.range(300).select(F.concat(F.lit("shop alpha"), "id", F.lit(" beta"), "id", F.lit(" gamma"), "id").alias("name"))
    right = spark.range(300, 600).select(F.concat(F.lit("shop delta"), "id", F.lit(" kappa"), "id", F.lit(" sigma"), "id").alias("known"))
    assert names.candidates(left, right, 0.75).count() == 0
    with pytest.raises(ValueError, match="above"):
        names.candidates(left, right, 0.6)
    assert names.near_names(left.limit(0), right).collect() == [] and names.near_names(left, right.limit(0)).collect() == []


def test_pairs_that_share_frequent_words_are_scored_in_all_tasks(spark):
    """Many short pairs: the tasks that score them are as many as given, not as their bytes ask for; texts are compared in blocks."""
    rng = random.Random(5)
    rows = spark.createDataFrame([(" ".join(rng.choices(["red", "old", "ring", "bolt", "brand#1", "brand#12"], k=3)),) for _ in range(200)], "name string")
    pairs = names.candidates(rows.distinct(), rows.distinct().withColumnRenamed("name", "known"), 0.75)
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = (["".join(rng.choices("abcé ", k=rng.choice([0, 1, 3, 9, 200]))) for _ in range(400)] for _ in range(2))
    assert text.jaro_winkler_all(a, b).tolist() == [text.jaro_winkler(x, y) for x, y in zip(a, b)]
