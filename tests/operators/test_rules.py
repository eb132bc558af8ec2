from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerlake.operators import categorise, inference

TX = "transaction_id string, user_id bigint, merchant_name string, description string, category_primary string, category_detailed string"


def test_source_level_beats_length_and_length_beats_priority(spark):
    rules = categorise.rules_frame(spark, [("shop", "a", 99, 2), ("shop one", "b", 1, 2), ("shop one more", "c", 99, 3), ("zzz", "d", 1, 1)])
    tx = spark.createDataFrame([("1", 1, "Shop One More", "x", None, None), ("2", 1, None, "zzz shop one more", None, None), ("3", 1, None, None, None, None)], TX)
    assert {r.transaction_id: r.rule_category for r in categorise.match_rules(tx, rules).collect()} == {"1": "b", "2": "d"}


def test_the_first_layer_that_knows_decides(spark):
    rules = categorise.rules_frame(spark, [("shop", "rule", 1, 2)])
    own = spark.createDataFrame([(1, "MINE", "own")], "user_id bigint, merchant_name string, category string")
    tx = spark.createDataFrame([("1", 1, "Mine", "shop", "p", "dining"), ("2", 2, "Mine", "shop", "p", "Dining"), ("3", 2, "Mine", "shop", "p", None), ("4", 2, "Mine", "none", "p", None), ("5", 2, None, None, None, None)], TX)
    got = {r.transaction_id: (r.category, r.layer) for r in categorise.cascade(tx, own, rules).collect()}
    assert got == {"1": ("own", "USER"), "2": ("dining", "ISSUER"), "3": ("rule", "RULE"), "4": ("p", "IMPORT"), "5": ("other", "DEFAULT")}


def test_types_by_account_sign_and_words(spark):
    rows = [("creditCard", "5", "shop"), ("creditCard", "5", "Payment received"), ("creditCard", "-5", "x"), ("ira", "-5", "annual fee"), ("ira", "-5", "buy"), ("mortgage", "5", "x"), ("checking", "-5", "autopay"), ("checking", "0", "x"), ("odd", "5", "x"), (None, "-5", None)]
    df = spark.createDataFrame([(i, a, D(m), d) for i, (a, m, d) in enumerate(rows)], "i int, a string, m decimal(19,2), d string")
    got = df.select("i", inference.transaction_type(inference.account_kind(F.col("a")), F.col("m"), F.col("d")).alias("t")).orderBy("i").collect()
    assert [r.t and (r.t.type, r.t.confidence) for r in got] == [("EXPENSE", 0.95), ("PAYMENT", 0.95), ("PAYMENT", 0.95), ("EXPENSE", 0.95), ("INVESTMENT", 0.95), ("PAYMENT", 0.90), ("PAYMENT", 0.95), None, ("INCOME", 0.60), ("EXPENSE", 0.60)]


def test_nearest_reference_leaves_a_vector_itself_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r.nearest for r in categorise.nearest_reference(v, v.where("vec_id < 3")).collect()}
    assert got == {1: 2, 2: 1}
    assert categorise.nearest_reference(v, v.limit(0)).collect() == []


def model_rows(spark):
    columns = "transaction_id string, merchant_name string, description string, category_primary string, amount decimal(19,2), import_source string"
    return spark.createDataFrame([("1", "Shop", "green tea green", "a", D("5"), "CSV"), ("2", None, "the tea\tof", "b", D("-60"), None), ("3", "SHOP", None, "b", None, "CSV"), ("4", None, "", None, D("70"), "PDF"), ("5", "New", "unseen ü", None, D("300"), "PDF")], columns)


def test_predictions_by_columns_and_by_rows(spark, monkeypatch):
    tx = model_rows(spark)
    model = categorise.learn_frequencies(tx)
    assert {(r.feature, r.category_primary): r.p for r in model.collect()} == {("m:shop", "a"): 0.5, ("m:shop", "b"): 0.5, ("k:green", "a"): 1, ("k:tea", "a"): 0.5, ("k:tea", "b"): 0.5, ("a:tiny", "a"): 1, ("a:medium", "b"): 1, ("a:huge", "b"): 1, ("s:CSV", "a"): 0.5, ("s:CSV", "b"): 0.5, ("s:none", "b"): 1}
    # 1: .4/2 + .3 + .3/2 + .3 + .15 + .15/2; 2: .3/2 + .15 + .15; 3: .4/2 + .15 + .15/2; 4: .15 by the amount alone; 5 has no known feature.
    want = {"1": ("a", 1.175), "2": ("b", 0.45), "3": ("b", 0.425), "4": ("b", 0.15)}
    predicted = lambda t, m: {r.transaction_id: (r.predicted, r.score) for r in categorise.score_frequencies(t, m).collect()}
    ties = spark.createDataFrame([("m:shop", "z", 0.5), ("m:shop", "B", 0.5), ("m:shop", "b", 0.5)], "feature string, category_primary string, p double")
    for rows in (100, 2):
        monkeypatch.setattr(categorise, "MODEL_ROWS", rows)
        assert predicted(tx, model) == want
        assert predicted(tx, ties) == {"1": ("B", 0.2), "3": ("B", 0.2)}
        assert predicted(tx.unionAll(tx), model) == {i: (c, 2 * x) for i, (c, x) in want.items()}  # a repeated transaction counts as one with all features
        assert predicted(tx, model.limit(0)) == predicted(tx.limit(0), model) == {}


def test_transactions_are_not_joined_with_a_row_a_category(spark):
    tx = model_rows(spark)
    plan = categorise.score_frequencies(tx, categorise.learn_frequencies(tx))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(transaction_id" in plan


def test_the_full_cascade_joins_no_features_by_shuffle(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["c12_full_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [feature" in plan and "hashpartitioning(feature" not in plan
