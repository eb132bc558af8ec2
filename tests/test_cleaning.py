import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import cleaning as K
from ledgerlake.functions import kinds as N


def values(spark, rows, *columns):
    names = ", ".join(f"c{i} string" for i in range(len(rows[0])))
    return [tuple(r) for r in spark.createDataFrame(rows, names).select(*columns).collect()]


def test_clean_merchants(spark):
    texts = ["SQ *Blue Bottle", "SQ*Blue Bottle #123 WA", "POS DEBIT Costco 98101", "Shop ACH DEBIT here", "call 206-555-0100 now", None, "  ", "PAYPAL *STEAM GAMES"]
    got = [r[0] for r in values(spark, [(t,) for t in texts], K.clean_merchant(F.col("c0")))]
    assert got == ["sq *blue bottle", "blue bottle", "costco", "shop here", "call 206-555- now", "", "", "steam games"]


def test_stems_and_synonyms(spark):
    words = ["groceries", "parking", "diners", "boxes", "parked", "diner", "cats", "glass", "gas", None]
    got = [r[0] for r in values(spark, [(w,) for w in words], K.stem(F.col("c0")))]
    assert got == ["grocery", "park", "diners"[:-2], "box", "park", "din", "cat", "glass", "gas", None]
    assert values(spark, [("the Cafe and markets",)], K.expanded_words(F.col("c0")))[0][0] == ["cafe", "grocery", "market", "markets", "restaurant"]


def test_scores(spark):
    pairs = [("store safeway", "safeway store"), ("openai chatgpt subscr", "openai"), ("walmart", "mart"), ("abc", ""), ("costco", "costco wholesale"), ("summit coffee", "sumit")]
    inside = [r[0] for r in values(spark, pairs, K.contained(F.col("c0"), F.col("c1")))]
    assert inside == pytest.approx([0.8, 0.95 + 6 / 21 * 0.05, 0.95 + 4 / 7 * 0.05, 0, 0.4, 0])
    shared = [r[0] for r in values(spark, pairs, K.boosted_jaccard(F.col("c0"), F.col("c1")))]
    assert shared == pytest.approx([1, 1 / 3 + 0.2, 0, 0, 0.5 + 0.2, 0])
    score = [r[0] for r in values(spark, [("store safeway", "safeway store"), ("same", "same"), ("abc", "xyz")], K.fuzzy_score(F.col("c0"), F.col("c1")))]
    assert score[1] == pytest.approx(1) and score[2] == 0 and 0.7 < score[0] < 1


def test_keys_lookups_and_kinds(spark):
    rows = [("Shop ", "x"), (None, "Pay 12 to ACME corporation of somewhere else 99"), ("", " "), (None, None)]
    assert [r[0] for r in values(spark, rows, K.pattern_key(F.col("c0"), F.col("c1")))] == ["shop", "pay to acme corporation of som", None, None]
    assert [r[0] for r in values(spark, [("a",), ("z",), (None,)], K.lookup({"a": 3.0, "default": 2.0}, F.col("c0")))] == [3, 2, 2]
    assert [r[0] for r in values(spark, [("z",)], K.lookup({"a": 3.0}, F.col("c0")))] == [1]
    cases = [("Netflix", "", "entertainment", None), ("Netflix", "", "other", None), ("YouTube Music", "", None, None), ("ChatGPT", "", None, None), ("Adobe", "", None, "SaaS tools"), ("Dropbox", "", None, "cloud"), ("Acme insurance", "", None, None), ("City gym", "", None, None)]
    schema = "merchant_name string, description string, category_primary string, category_detailed string"
    got = spark.createDataFrame(cases, schema).select(N.subscription_type(), N.subscription_category()).collect()
    assert [tuple(r) for r in got] == [("streaming", "subscription"), ("other", "recurring"), ("streaming", "subscription"), ("ai_service", "subscription"), ("software", "subscription"), ("cloud_storage", "subscription"), ("other", "recurring"), ("membership", "subscription")]
