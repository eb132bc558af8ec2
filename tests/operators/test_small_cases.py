import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.text import jaro_winkler
from ledgerlake.operators import aggregates, anomalies, budgets, imports, overview, recurrence, subscriptions
from ledgerlake.sources.keyed import KeyedTable
from ledgerlake.sources import tables
from ledgerlake.streaming import activity

TX = "transaction_id string, user_id bigint, account_id bigint, amount decimal(19,2), description string, merchant_name string, category_primary string, category_detailed string, transaction_date date, currency_code string, plaid_transaction_id string, pending boolean, is_hidden boolean, goal_id string, round_up_source_transaction_id string, import_source string, updated_at_ts bigint, deleted boolean"
BUDGET = "budget_id string, user_id bigint, category string, monthly_limit decimal(19,2), period string, currency_code string, rollover_enabled boolean, carried_amount decimal(19,2), goal_id string, goal_allocation decimal(19,2), last_alerted_threshold int, last_goal_funded decimal(19,2)"


def tx(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        base = dict(transaction_id=f"t{i}", user_id=1, account_id=10, amount=D("-10"), description="d", merchant_name="Shop", category_primary="groceries", category_detailed=None, transaction_date=dt.date(2024, 1, 10), currency_code="USD", plaid_transaction_id=None, pending=False, is_hidden=None, goal_id=None, round_up_source_transaction_id=None, import_source=None, updated_at_ts=i, deleted=False)
        out.append(tuple((base | r).values()))
    return spark.createDataFrame(out, TX)


def budget(spark, **r):
    base = dict(budget_id="b", user_id=1, category="groceries", monthly_limit=D("100"), period="monthly", currency_code="USD", rollover_enabled=False, carried_amount=D("7"), goal_id=None, goal_allocation=D("0"), last_alerted_threshold=0, last_goal_funded=D("0"))
    return spark.createDataFrame([tuple((base | r).values())], BUDGET)


def spent(spark, rows, **b):
    return budgets.budget_summary(budget(spark, **b), tx(spark, *rows), "2024-01-15").first().spent


def test_refunds_net_to_zero_and_not_below(spark):
    assert spent(spark, [{"amount": D("-200")}, {"amount": D("200")}]) == 0
    assert spent(spark, [{"amount": D("50")}]) == 0


def test_deleted_pending_and_foreign_rows_stay_out_and_blank_currency_matches(spark):
    assert spent(spark, [{"deleted": True}, {"pending": True}, {"currency_code": "EUR"}, {"currency_code": ""}, {"currency_code": "usd"}]) == 20


def test_equal_primary_and_detailed_count_once(spark):
    assert spent(spark, [{"category_detailed": "groceries"}, {"category_primary": "x", "category_detailed": "groceries"}]) == 20


@pytest.mark.parametrize(("amount", "last", "reached", "alert", "mark"), [("-80.24", 0, 50, True, 50), ("-80.25", 0, 75, True, 75), ("-50.00", 75, 0, False, 0), ("-60.00", 75, 50, False, 75)])
def test_thresholds_with_hysteresis(spark, amount, last, reached, alert, mark):
    r = budgets.threshold_crossings(budget(spark, last_alerted_threshold=last), tx(spark, {"amount": D(amount)}), "2024-01-15").first()
    assert (r.reached, r.alert, r.bookmark) == (reached, alert, mark)


def test_months_without_rows_are_filled_in_trends_and_skipped_in_medians(spark):
    rows = tx(spark, {"transaction_date": dt.date(2024, 1, 5)}, {"transaction_date": dt.date(2024, 3, 5), "amount": D("-30")})
    trend = aggregates.monthly_spend(rows, "2024-03-20", 3).orderBy("month").collect()
    assert [r.value for r in trend] == [10, 0, 30]
    assert aggregates.median_monthly_income_expense(rows, "2024-03-20").first().median_expense == 20


@pytest.mark.parametrize(("gap", "amount", "n"), [(0, "-60", 1), (1, "-60", 1), (2, "-60", 0), (0, "-49.99", 0), (0, "-50", 1)])
def test_duplicate_charges(spark, gap, amount, n):
    rows = tx(spark, {"amount": D(amount)}, {"amount": D(amount), "transaction_date": dt.date(2024, 1, 10 + gap)})
    got = anomalies.duplicate_charges(rows, "2024-01-20").collect()
    assert [r.transaction_id for r in got] == ["t0"][:n]


def test_no_outliers_without_variance(spark):
    rows = [{"transaction_date": dt.date(2024, 1, 1) + dt.timedelta(days=k)} for k in range(20)] + [{"transaction_date": dt.date(2023, 9, 1) + dt.timedelta(days=k)} for k in range(20)]
    prefs = spark.createDataFrame([(1, "NORMAL")], "user_id bigint, anomaly_sensitivity string")
    assert anomalies.statistical_outliers(tx(spark, *rows), prefs, "2024-02-15").collect() == []


def test_only_the_first_row_of_a_new_merchant(spark):
    rows = tx(spark, {"merchant_name": "New", "amount": D("-150")}, {"merchant_name": "New", "amount": D("-300"), "transaction_date": dt.date(2024, 1, 12)}, {"merchant_name": "Rent", "amount": D("-900"), "category_primary": "rent"})
    assert [r.transaction_id for r in anomalies.first_time_merchants(rows, "2024-01-20").collect()] == ["t0"]


def test_nearest_earlier_charge_on_another_account(spark):
    rows = tx(spark, {"account_id": 1}, {"account_id": 2, "transaction_date": dt.date(2024, 1, 12)}, {"account_id": 1, "transaction_date": dt.date(2024, 1, 16)})
    got = anomalies.near_duplicates_across_accounts(rows, "2024-01-20").collect()
    assert [(r.transaction_id, r.earlier_id, r.days_apart) for r in got] == [("t1", "t0", 2)]


def test_a_monthly_price_change_is_one_subscription_and_a_variable_bill_none(spark):
    days = [dt.date(2024, k + 1, 5) for k in range(12)]
    sub = [{"merchant_name": "Streamly", "category_primary": "subscriptions", "transaction_date": d, "amount": D("-10") if k < 6 else D("-12")} for k, d in enumerate(days)]
    bill = [{"merchant_name": "Power", "category_primary": "insurance", "transaction_date": d, "amount": -D(["10", "13", "16"][k // 4])} for k, d in enumerate(days)]
    got = subscriptions.consolidate(subscriptions.detect(tx(spark, *sub, *bill))).collect()
    assert [(r.merchant, r.frequency, r.amount, r.n_prices) for r in got] == [("streamly", "MONTHLY", 12, 2)]


@pytest.mark.parametrize(("share", "label"), [("105", "CREEPING"), ("115", "SPIKING"), ("104.99", "STABLE")])
def test_creep_bands(spark, share, label):
    rows = [("a", 1, "m", D("100"), "MONTHLY", dt.date(2020, 1, 1), True), ("b", 1, "n", D(share) - 100, "MONTHLY", dt.date(2024, 1, 1), True)]
    subs = spark.createDataFrame(rows, "subscription_id string, user_id bigint, merchant_name string, amount decimal(19,2), frequency string, start_date date, active boolean")
    assert subscriptions.creep(subs, "2024-01-20").first().trend == label


def test_import_matches(spark):
    known = tx(spark, {"transaction_id": "k1"}, {"transaction_id": "k2", "plaid_transaction_id": "p", "amount": D("-99")})
    new = tx(spark, {"transaction_id": "n1", "amount": D("10")}, {"transaction_id": "n2", "plaid_transaction_id": "p", "amount": D("-5")}, {"transaction_id": "n3", "description": "other text", "amount": D("-77"), "transaction_date": dt.date(2024, 1, 12)})
    got = {r.new_id: (r.known_id, r.kind) for r in imports.duplicates(new, known).collect()}
    assert got == {"n1": ("k1", "EXACT"), "n2": ("k2", "SAME_ID")}
    assert [r.transaction_id for r in imports.import_rows(new, known).collect()] == ["n3"]


def test_import_matches_at_every_distance(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    known = [{"transaction_id": "a", "plaid_transaction_id": "p", "amount": D("-99"), "transaction_date": day(0)}]  # posted 20 days after
    known += [{"transaction_id": f"far{d}", "plaid_transaction_id": f"q{d}", "amount": D("-98"), "transaction_date": day(20 - d)} for d in (35, 36)]
    text = "card payment at the corner"  # one letter of 26 differs: similarity 0.9615
    known += [{"transaction_id": f"k{d}", "user_id": 100 + d, "amount": D("-20"), "description": text, "transaction_date": day(20 + d)} for d in range(14)]
    known += [{"transaction_id": f"r{d}", "user_id": 200 + d, "amount": D("-20"), "transaction_date": day(20 + d)} for d in range(1, 6)]
    new = [{"transaction_id": "n", "plaid_transaction_id": "p", "amount": D("-5"), "transaction_date": day(20)}]
    new += [{"transaction_id": f"near{d}", "plaid_transaction_id": f"q{d}", "amount": D("-3"), "description": "other", "transaction_date": day(20)} for d in (35, 36)]
    new += [{"transaction_id": f"n{d}", "user_id": 100 + d, "amount": D("-20"), "description": text[:-1] + "x", "transaction_date": day(20)} for d in range(14)]
    new += [{"transaction_id": f"again{d}", "user_id": 200 + d, "amount": D("-20"), "transaction_date": day(20)} for d in range(1, 6)]
    known, new = tx(spark, *known), tx(spark, *new)
    for least, reach in ((0.90, 3), (0.85, 7), (0.80, 13)):
        got = {r.new_id: (r.known_id, r.kind, r.score) for r in imports.duplicates(new, known, least).collect()}
        assert got["n"] == ("a", "SAME_ID", 1) and got["near35"] == ("far35", "SAME_ID", 1) and got.get("near36", ("", ""))[1] != "SAME_ID"
        similar = {i: m for i, m in got.items() if m[1] == "SIMILAR" and i[1:].isdigit()}
        by_day = lambda d: next(x for most, x in ((0, 1), (1, 0.9), (3, 0.8), (7, 0.5), (30, 0.3)) if d <= most)
        assert similar == {f"n{d}": (f"k{d}", "SIMILAR", round(0.3 + 0.2 * by_day(d) + 0.3 * (1 - 1 / 26) + 0.2, 4)) for d in range(reach + 1)}
        assert not [i for i in got if i.startswith("again")]  # equal texts and amounts on other days recur
    assert "n" not in {r.transaction_id for r in imports.import_rows(new, known).collect()}


def test_fuzzy_merchants_differ_in_the_first_letter_too(spark):
    subs = spark.createDataFrame([("s", 1, "New York Times", D("10")), ("t", 1, "The New York Times", D("99")), ("u", 2, "Finity", D("10"))], "subscription_id string, user_id bigint, merchant_name string, amount decimal(19,2)")
    rows = tx(spark, {"merchant_name": "The New York Times"}, {"merchant_name": "York"}, {"merchant_name": "Xfinity", "user_id": 2}, {"merchant_name": "Xfinity", "user_id": 3})
    assert sorted((r.subscription_id, r.name) for r in subscriptions.matched_payments(subs, rows).collect()) == [("s", "thenewyorktimes"), ("u", "xfinity")]


def test_merchant_clusters_are_those_of_one_pass(spark):
    import random

    rng, users = random.Random(3), {}
    for user in range(6):
        base = ["".join(rng.choice("abcd") for _ in range(rng.choice([6, 9, 14]))) for _ in range(5)]
        users[user] = {n[:k] + rng.choice(["", "a", "b"]) + n[k + rng.choice([0, 1]) :] for n in base for k in (0, 0, 1, 4, 5, 6)} | {"xfinitytelevision", "finitytelevision"}
    want, other_letter = [], 0
    for user, names in users.items():
        left = sorted(names)
        while left:
            head = left[0]
            mine = [m for m in left if m == head or jaro_winkler(head, m) >= 0.90]
            other_letter += sum(m[0] != head[0] for m in mine)
            want += [(user, head, m) for m in mine]
            left = [m for m in left if m not in mine]
    got = overview.merchant_clusters(tx(spark, *[{"user_id": u, "merchant_name": n} for u, names in users.items() for n in names])).collect()
    assert other_letter and sorted(map(tuple, got)) == sorted(want)


def test_appending_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.append_new(tx(spark, {}, {}), path)
    assert spark.read.parquet(path).count() == 2


def test_ema_folds_oldest_first(spark):
    rows = tx(spark, *[{"amount": D(a), "goal_id": "g", "transaction_date": dt.date(2024, m, 5)} for m, a in ((3, "40"), (1, "10"), (2, "20"))])
    assert recurrence.exponential_average(rows).first().ema == 27.5


EVENTS = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i % 3, ["view", "error"][i % 2], float(i), "{}") for i in range(60)]


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "events")
    for k in range(3):
        spark.createDataFrame(EVENTS[20 * k : 20 * (k + 1)], activity.EVENTS).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("op", [activity.window_counts, lambda e: activity.once(e).select("event_id"), activity.token_bucket_stream])
def test_streams_equal_batches(spark, folder, tmp_path, op):
    out = op(activity.read_stream(spark, folder, 1))
    mode = "update" if op is activity.token_bucket_stream or op is activity.window_counts else "append"
    name = f"s{abs(hash(str(tmp_path)))}"
    q = out.writeStream.format("memory").queryName(name).outputMode("append" if op is activity.token_bucket_stream else mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.table(name).collect()]
    batch = spark.read.parquet(folder)
    if op is activity.token_bucket_stream:
        assert sorted(got) == sorted(map(tuple, activity.token_bucket(batch).collect()))
    elif op is activity.window_counts:
        last = {(r[0], r[1]): r for r in got}
        assert sorted(last.values()) == sorted(map(tuple, op(batch).collect()))
    else:
        assert sorted(got) == sorted(map(tuple, op(batch).collect()))


def test_upserts_replace_rows(spark, folder, tmp_path):
    stream = activity.read_stream(spark, folder, 1).withColumn("event_id", F.col("event_id") % 25)
    activity.upsert_stream(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination(120)
    rows = KeyedTable(spark, str(tmp_path / "table"), "event_id", "ts").read().collect()
    assert {r.event_id: r.value for r in rows} == {i % 25: float(i) for i in range(60)}


@pytest.mark.parametrize("least", [0.8, 0.85, 0.9])
def test_pairs_that_can_reach_the_score_are_kept_before_texts_are_compared(spark, least):
    rng = random.Random(11)
    amount = lambda: rng.choice(["0.00", "0.01", "-0.02", "10.00", "10.01", "10.05", "10.50", "-10.00", "1999.99", "2000.00", "2010.00", "2099.00"])
    text = lambda: rng.choice(["pos merchant number one of all", "pos merchant number one of al1", "pos merchant", ""])
    rows = [(amount(), amount(), f"2024-01-{rng.randint(1, 31):02}", f"2024-01-{rng.randint(1, 31):02}", text(), text(), rng.choice(["", "shop"]), rng.choice(["", "shop"])) for _ in range(5000)]
    pairs = spark.createDataFrame(rows, "na string, ka string, nd string, kd string, n_text string, k_text string, n_name string, k_name string")
    pairs = pairs.selectExpr("CAST(na AS DECIMAL(19,2)) AS n_amount", "CAST(ka AS DECIMAL(19,2)) AS k_amount", "CAST(na AS DOUBLE) AS n_value", "CAST(ka AS DOUBLE) AS k_value", "CAST(nd AS DATE) AS n_date", "CAST(kd AS DATE) AS k_date", "n_text", "k_text", "n_name", "k_name")
    told = pairs.select((imports._score() >= least).alias("scores"), imports._may_reach(least).alias("may")).collect()
    assert any(r.scores for r in told) and all(r.may for r in told if r.scores) and sum(r.may for r in told) < 0.7 * len(told)
