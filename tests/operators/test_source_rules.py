"""Hand-computed cases of rules that must be as the source system has them."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.filters import is_transfer
from ledgerlake.operators import categorise, merchants, subscriptions
from ledgerlake.streaming import activity

AT = "2024-06-30"
DAY = dt.date(2024, 6, 30)
SUBS = "subscription_id string, user_id bigint, merchant_name string, amount decimal(19,2), frequency string, start_date date, last_payment_date date, active boolean"
TX = "transaction_id string, user_id bigint, merchant_name string, description string, category_primary string, category_detailed string, amount decimal(19,2), transaction_date date, payment_channel string, importer_category_primary string, importer_category_detailed string, deleted boolean"


def back(n):
    return DAY - dt.timedelta(n)


def sub(spark, *rows):
    base = dict(subscription_id="s", user_id=1, merchant_name="Shop", amount=D("10"), frequency="MONTHLY", start_date=back(400), last_payment_date=back(5), active=True)
    return spark.createDataFrame([tuple((base | {"subscription_id": f"s{i}"} | r).values()) for i, r in enumerate(rows)], SUBS)


def tx(spark, *rows):
    base = dict(transaction_id="t", user_id=1, merchant_name="Shop", description="d", category_primary=None, category_detailed=None, amount=D("-10"), transaction_date=back(3), payment_channel=None, importer_category_primary=None, importer_category_detailed=None, deleted=False)
    return spark.createDataFrame([tuple((base | {"transaction_id": f"t{i}"} | r).values()) for i, r in enumerate(rows)], TX)


def test_lifecycle_states_begin_on_the_day(spark):
    days = [59, 60, 89, 90, 119, 120]  # monthly: 60 unused days
    got = subscriptions.lifecycle(sub(spark, *[{"last_payment_date": back(d)} for d in days]), AT).orderBy("quiet").collect()
    assert [r.state for r in got] == ["ACTIVE", "UNUSED_1_CYCLE", "UNUSED_1_CYCLE", "UNUSED_2_CYCLES", "UNUSED_2_CYCLES", "PRESUMED_CANCELLED"]


def test_health_penalties(spark):
    subs = sub(spark, {}, {"last_payment_date": back(46), "merchant_name": "B"}, {"last_payment_date": back(61), "merchant_name": "C"}, {"last_payment_date": None, "merchant_name": "E"}, {"merchant_name": "Two"}, {"merchant_name": "TWO"}, {"merchant_name": "Rise", "amount": D("100")})
    rows = tx(spark, {"merchant_name": " rise", "amount": D("-95"), "transaction_date": back(60)}, {"merchant_name": "RISE", "amount": D("-105")}, {"merchant_name": "Rise", "amount": D("-200"), "transaction_date": back(1)})
    got = {r.subscription_id: r.score for r in subscriptions.health(subs, rows, AT).collect()}
    assert got == {"s0": 100, "s1": 85, "s2": 70, "s3": 80, "s4": 80, "s5": 80, "s6": 90}


def test_engagement_score(spark):
    subs = sub(spark, {"merchant_name": "Mo"}, {"merchant_name": "Mo", "active": False}, {"merchant_name": "None"}, {"merchant_name": "Yr", "frequency": "ANNUAL"})
    rows = tx(spark, *[{"merchant_name": "m o", "transaction_date": back(d)} for d in (6, 36, 66)], {"merchant_name": "Yr", "transaction_date": back(73)})
    got = {r.subscription_id: (r.score, r.tier) for r in subscriptions.engagement(subs, rows, AT).collect()}
    # 0.45 * (1 - 6 / 60) + 0.25 + 0.15 + 0.15 = 0.955; yearly 0.45 * (1 - 73 / 730) + 0.25 + 0.15 + 0.15
    assert got == {"s0": (96, "ACTIVE"), "s1": (81, "DORMANT"), "s2": (30, "DORMANT"), "s3": (96, "ACTIVE")}


def test_creep_looks_back_thirty_days_and_is_one_from_nothing(spark):
    subs = sub(spark, {"start_date": back(30)}, {"start_date": back(29), "amount": D("1")}, {"user_id": 2, "start_date": back(3)}, {"user_id": 3, "start_date": None, "frequency": "WEEKLY"})
    got = {r.user_id: (r.now, r.before, float(r.share), r.trend) for r in subscriptions.creep(subs, AT).collect()}
    assert got == {1: (D("11"), D("10"), 0.1, "CREEPING"), 2: (D("10"), D("0"), 1.0, "SPIKING"), 3: (D("43.48"), D("43.48"), 0.0, "STABLE")}


def test_transfers(spark):
    cases = [({"category_primary": "transfer_out"}, True), ({"description": "coach transfer station"}, True), ({"description": "a transfer station"}, False), ({"description": "wire TRANSFER in"}, True), ({"merchant_name": "Zelle Bob"}, True), ({"importer_category_primary": "LOAN_PAYMENTS"}, True), ({"importer_category_primary": "loan_payments"}, False), ({"importer_category_detailed": "TRANSFER_IN_DEPOSIT"}, True), ({"description": "autopay"}, False), ({"category_detailed": "CC Payment"}, True)]
    rows = tx(spark, *[c for c, _ in cases]).withColumn("is", is_transfer()).orderBy(F.length("transaction_id"), "transaction_id").collect()
    assert [r["is"] for r in rows] == [w for _, w in cases]


@pytest.mark.parametrize(
    ("row", "wanted"),
    [
        ({"description": "PAYROLL", "amount": D("5")}, "SALARY"),
        ({"description": "PAYROLL"}, "OTHER"),
        ({"description": "vest", "merchant_name": "Stock Vest", "amount": D("5")}, "OTHER"),
        ({"description": "stock vest", "amount": D("5")}, "RSU"),
        ({"description": "coach fee"}, "ACH_EXPENSE"),
        ({"payment_channel": "ACH", "amount": D("5")}, "ACH_INCOME"),
        ({"description": "mortgage interest"}, "MORTGAGE_INTEREST"),
        ({"category_primary": "Interest"}, "INTEREST"),
        ({"merchant_name": "H&R Block"}, "CPA"),
        ({"merchant_name": "State University"}, "TUITION"),
        ({"description": "county tax"}, "LOCAL_TAX"),
        ({"category_primary": "healthcare"}, "MEDICAL"),
        ({"category_primary": "investment", "amount": D("5")}, "CAPITAL_GAIN"),
        ({"description": "capital gain"}, "CAPITAL_LOSS"),
    ],
)
def test_tax_classes(spark, row, wanted):
    if wanted == "OTHER" and row.get("merchant_name"):
        wanted = "RSU"  # the merchant counts for stock grants
    assert tx(spark, row).select(categorise.tax_class()).first()[0] == wanted


def test_deductibility_by_merchant(spark):
    names = ["Adobe", "Netflix", "AT&T", "Attic", "Shop", None, "Wavelength HBO"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "m string").select(categorise.deductibility(F.col("m"))).collect()]
    assert got == ["FULL", "NONE", "UNKNOWN", "PARTIAL", "UNKNOWN", "UNKNOWN", "FULL"]


def test_behaviour_risk_is_the_weighted_mean(spark):
    at = dt.datetime(2024, 1, 10, 12)
    rows = [(i, 1, at - dt.timedelta(hours=24 * (i + 1)), "view", "/x", "READ") for i in range(9)]  # nine at the same hour, 216 hours
    rows += [(100, 1, at - dt.timedelta(minutes=5), "erase", "/admin/users", "delete")]
    got = activity.behaviour_risk(spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, kind string, resource string, action string"), F.lit(str(at)).cast("timestamp")).collect()
    # one of ten kinds is not under a tenth: 0; resource 80, action 70, time 0; one an hour is over three times 10 / 216: 70
    assert [(r.event_id, r.risk, r.level) for r in got] == [(100, pytest.approx((13 * 80 + 12 * 70 + 8 * 70) / 75, abs=1e-4), "LOW")]


def test_merchant_directory(spark):
    directory = spark.createDataFrame([("Blue Bottle Coffee", "dining", ["BBC Oakland"]), ("Safeway", "groceries", []), ("Whole Foods", "groceries", None)], "name string, category string, aliases array<string>")
    names = ["blue-bottle coffee", "bbc oakland", "Safeway Store 12", "Whole Foods Market", "Blue Botle Coffee", "Safewy", "nothing", None, " "]
    got = {r.transaction_id: (r.category, r.source, r.confidence) for r in merchants.merchant_categories(tx(spark, *[{"merchant_name": n} for n in names]), directory).collect()}
    assert got == {
        "t0": ("dining", "MERCHANT_DB_EXACT", 0.95),
        "t1": ("dining", "MERCHANT_DB_ALIAS", 0.95),
        "t2": ("groceries", "MERCHANT_DB_PREFIX", 0.93),
        "t3": ("groceries", "MERCHANT_DB_PREFIX", 0.93),
        "t4": ("dining", "MERCHANT_DB_FUZZY", pytest.approx(0.9 + (15 / 16 - 0.85) * 0.1, abs=1e-6)),
        "t5": ("groceries", "MERCHANT_DB_FUZZY", pytest.approx(0.9 + (6 / 7 - 0.85) * 0.1, abs=1e-6)),
    }


def test_fuzzy_names_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    known = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 34))) for _ in range(60)]

    def edited(w):
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abcd") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abcd") + w[i + 1 :]])
        return w

    names = sorted({edited(rng.choice(known)) for _ in range(300)})
    k = spark.createDataFrame([(w, 0, w) for w in sorted(set(known))], "key string, is_alias int, category string")
    n = spark.createDataFrame([(w, w) for w in names], "name string, key string")
    got = {r.name: round(r.similarity, 6) for r in merchants.fuzzy(n, k).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    wanted = {}
    for a in names:
        scores = [1 - distance(a, b) / max(len(a), len(b)) for b in set(known) if len(a) >= 4 and abs(len(a) - len(b)) <= 3]
        if scores and max(scores) >= 0.85:
            wanted[a] = round(max(scores), 6)
    assert got == wanted and len(wanted) > 50


def test_balance_drift_between_readings(spark):
    import datetime as dt
    from decimal import Decimal as D

    from ledgerlake.operators import accounts as A

    d = lambda n: dt.date(2024, 1, n)
    balances = spark.createDataFrame([(1, d(1), D(100)), (1, d(10), D(70)), (1, d(20), D(90)), (1, d(20), D(80)), (2, d(1), D(50)), (2, d(10), D("80.50")), (3, d(1), D(5)), (1, None, D(1)), (1, d(5), None)], "account_id bigint, snapshot_date date, balance decimal(19,2)")
    accounts = spark.createDataFrame([(1, 7, "checking"), (2, 7, "creditCard"), (3, 7, None)], "account_id bigint, user_id bigint, account_type string")
    tx = spark.createDataFrame([(1, D(-10), d(1), False), (1, D(-20), d(10), False), (1, D(5), d(15), False), (1, D(99), d(5), True), (2, D(-30), d(3), False), (1, D(1000), d(25), False), (None, D(1), d(2), False)], "account_id bigint, amount decimal(19,2), transaction_date date, deleted boolean")
    got = sorted((r.account_id, r.since.day, r.snapshot_date.day, float(r.change), float(r.explained), float(r.drift), r.level) for r in A.balance_drift(balances, accounts, tx).collect())
    assert got == [(1, 1, 10, -30.0, -30.0, 0.0, None), (1, 10, 20, 20.0, -15.0, 35.0, "WARN"), (2, 1, 10, 30.5, 30.0, 0.5, None)]
