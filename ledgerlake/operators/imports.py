"""Imported rows against existing ones (rows J07, X13, X14, U02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import lengths_fit, levenshtein_similarity


#: Days around a user's new rows in which known rows are looked at.
AROUND = 35


#: What days apart and what amounts apart (as a share of their mean) score.
DATE_SCORES = ((0, 1.0), (1, 0.9), (3, 0.8), (7, 0.5), (30, 0.3))
AMOUNT_SCORES = ((0.001, 1.0), (0.005, 0.9), (0.01, 0.7), (0.05, 0.5))
#: Days apart at which equal descriptions and amounts are recurring payments, and their score.
RECURRING_DAYS, RECURRING_SCORE = ((1, 60), (88, 93), (180, 186), (365, 366)), 0.30


def _reach(least: float) -> int | None:
    """The most days apart at which a score can be `least`; None if days don't matter."""
    needed = least - 0.8  # amounts 0.3, descriptions 0.3, merchants 0.2
    days = [d for d, score in DATE_SCORES if 0.2 * score >= needed - 1e-9]
    return None if needed <= 1e-9 else max(days, default=0)


def _days() -> Column:
    return F.abs(F.datediff("n_date", "k_date"))


def _date_score() -> Column:
    date = F.when(F.lit(False), 0.0)
    for most, score in DATE_SCORES:
        date = date.when(_days() <= most, score)
    return date.otherwise(0.0)


def _may_reach(least: float) -> Column:
    """Whether a pair can score `least`, by amounts (as doubles, n_value and k_value), days and lengths of texts alone; some that can't pass.

    Texts add 0.3 at most, of which all but 0.05 only from a likeness of 0.95 on, and names 0.2. Amounts that are `off` apart score 1 - off at most, or 1 below
    the first share; the mean is rounded to cents and the share to four places.
    """
    off = F.abs(F.col("n_value") - F.col("k_value")) / (F.abs(F.col("n_value") + F.col("k_value")) / 2 + 0.0051) - 0.00006
    amount = F.when((F.col("n_value") >= 0) != (F.col("k_value") >= 0), 0.3).when(off < AMOUNT_SCORES[0][0], 1.0).otherwise(F.greatest(F.lit(0.5), 1 - off))
    texts = lengths_fit(F.col("n_text"), F.col("k_text"), 0.95) if least > 0.75 else F.lit(True)
    return (amount * 0.3 + _date_score() * 0.2 + 0.5 >= least - 1e-9) & texts


def _score() -> Column:
    """The similarity of a new row (n_*) and a known one (k_*)."""
    equal = (F.abs("n_amount") == F.abs("k_amount")) & (F.col("n_text") == F.col("k_text"))
    recurring = F.lit(False)
    for first, last in RECURRING_DAYS:
        recurring = recurring | _days().between(first, last)
    mean = F.abs(F.round((F.col("n_amount") + F.col("k_amount")).cast("decimal(20,2)") / 2, 2))
    off = F.round(F.abs(F.col("n_amount") - F.col("k_amount")).cast("decimal(20,2)") / F.when(mean != 0, mean), 4).cast("double")
    amount = F.when((F.col("n_amount") >= 0) != (F.col("k_amount") >= 0), 0.3).when(mean == 0, (F.col("n_amount") == F.col("k_amount")).cast("double"))
    for share, score in AMOUNT_SCORES:
        amount = amount.when(off < share, score)
    amount = amount.otherwise(F.greatest(F.lit(0.0), 1 - off))
    text = levenshtein_similarity(F.col("n_text"), F.col("k_text"))
    text = F.when(text >= 0.95, text * 0.3).when(text >= 0.5, text * 0.05).otherwise(text * 0.01)
    named = (F.col("n_name") != "") & (F.col("k_name") != "")
    name = F.when(named, levenshtein_similarity(F.col("n_name"), F.col("k_name")) * 0.2).otherwise(0.0)
    return F.when(equal & recurring, RECURRING_SCORE).otherwise(F.least(F.lit(1.0), amount * 0.3 + _date_score() * 0.2 + text + name))


def matches(new: DataFrame, known: DataFrame, least: float = 0.90, of_feed_id: int | None = None) -> DataFrame:
    """new_id, place, known_id, kind, score of all matches, a new row's best first: EXACT (same day, amount up to its sign, and description),
    SAME_ID, or SIMILAR from `least` on. of_feed_id: only so many known rows of one feed id, the least ids.

    Candidates are a user's known rows from AROUND days before the first to AROUND days after the last new row. Rows of one feed id
    are joined on it at any distance; others on the user and buckets of days, as far as the score can still be `least`. A new row that
    is among the known ones is not its own duplicate.
    """
    reach = _reach(least)
    bucket = lambda day, by=0: F.lit(0) if reach is None else F.floor((F.unix_date(F.col(day)) + by) / (reach + 1))
    text, name = F.regexp_replace(F.trim(F.lower(F.coalesce("description", F.lit("")))), r"\s+", " "), F.trim(F.lower(F.coalesce("merchant_name", F.lit(""))))
    n = new.select("user_id", F.col("transaction_id").alias("new_id"), F.col("amount").alias("n_amount"), F.col("amount").cast("double").alias("n_value"), F.col("transaction_date").alias("n_date"), text.alias("n_text"), name.alias("n_name"), F.col("plaid_transaction_id").alias("n_feed"))
    k = known.select(F.col("user_id").alias("k_user"), F.col("transaction_id").alias("known_id"), F.col("amount").alias("k_amount"), F.col("amount").cast("double").alias("k_value"), F.col("transaction_date").alias("k_date"), text.alias("k_text"), name.alias("k_name"), F.col("plaid_transaction_id").alias("k_feed"))
    span = n.groupBy(F.col("user_id").alias("k_user")).agg(F.date_add(F.min("n_date"), -AROUND).alias("first"), F.date_add(F.max("n_date"), AROUND).alias("last"))
    k = k.join(span, "k_user").where(F.col("k_date").between(F.col("first"), F.col("last"))).drop("first", "last")
    near = n.withColumn("bucket", F.explode(F.sequence(bucket("n_date", -(reach or 0)), bucket("n_date", reach or 0))))
    near = near.join(k.withColumn("k_bucket", bucket("k_date")), (F.col("user_id") == F.col("k_user")) & (F.col("bucket") == F.col("k_bucket")))
    near = near if reach is None else near.where(F.abs(F.datediff("n_date", "k_date")) <= reach)
    of_feed = k.where("k_feed IS NOT NULL")
    if of_feed_id:
        of_feed = of_feed.withColumn("r", F.dense_rank().over(Window.partitionBy("k_user", "k_feed").orderBy("known_id"))).where(F.col("r") <= of_feed_id).drop("r")
    fed = n.join(of_feed, (F.col("user_id") == F.col("k_user")) & (F.col("n_feed") == F.col("k_feed")))
    pairs = near.drop("bucket", "k_bucket").unionByName(fed).where("new_id <> known_id")
    exact = (F.col("n_date") == F.col("k_date")) & (F.abs("n_amount") == F.abs("k_amount")) & (F.col("n_text") == F.col("k_text"))
    same_id = F.coalesce(F.col("n_feed") == F.col("k_feed"), F.lit(False))
    kind = F.when(exact, "EXACT").when(same_id, "SAME_ID").when(F.col("score") >= least, "SIMILAR")
    # Distances of texts are asked of the few pairs that can still reach the score.
    found = pairs.where(exact | same_id | _may_reach(least)).withColumn("score", F.when(exact | same_id, 1.0).otherwise(_score())).withColumn("kind", kind).where("kind IS NOT NULL").withColumn("score", F.round("score", 4))
    best = Window.partitionBy("new_id").orderBy(F.desc("score"), "kind", "known_id")
    once = found if of_feed_id else found.dropDuplicates(["new_id", "known_id"])
    return once.withColumn("place", F.row_number().over(best)).select("new_id", "place", "known_id", "kind", "score")


def duplicates(new: DataFrame, known: DataFrame, least: float = 0.90) -> DataFrame:
    """new_id, known_id, kind, score: the best of matches(). Of one feed id the two least known ids do, as one may be the new row itself."""
    return matches(new, known, least, 2).where("place = 1").drop("place")


def import_rows(new: DataFrame, known: DataFrame) -> DataFrame:
    """The new rows that are no duplicates."""
    return new.join(duplicates(new, known).select(F.col("new_id").alias("transaction_id")), "transaction_id", "left_anti")
