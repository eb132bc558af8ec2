import datetime as dt
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerlake.functions.cleaning import clean_merchant, fuzzy_score
from ledgerlake.operators import clusters, subscriptions


def greedy(pairs):
    """One pass in order of name over (user, head, name)."""
    near, names = {}, {}
    for u, a, b in pairs:
        near.setdefault((u, a), set()).add(b)
        names.setdefault(u, set()).update((a, b))
    out = set()
    for u, ns in names.items():
        free = sorted(ns)
        while free:
            head, *rest = free
            taken = near.get((u, head), set()) & set(rest)
            out |= {(u, n, head) for n in taken}
            free = [n for n in rest if n not in taken]
    return out


def test_rounds_equal_one_pass(spark):
    rng = random.Random(8)
    pairs = {(u, *sorted(rng.sample([f"n{i:02}" for i in range(size)], 2))) for u, size in ((1, 12), (2, 30), (3, 5)) for _ in range(3 * size)}
    pairs |= {(4, f"c{i:02}", f"c{i + 1:02}") for i in range(12)}  # a chain: each name waits for the one before
    got = {tuple(r) for r in clusters.heads(spark.createDataFrame(sorted(pairs), "user_id bigint, head string, merchant string")).collect()}
    assert got == greedy(pairs)
    assert clusters.heads(spark.createDataFrame([], "user_id bigint, head string, merchant string")).collect() == []


def words_alike(a, b):
    key = lambda w: w[:4] + "*" if len(w) >= 4 else w
    x, y = ({w for w in n.lower().split() if len(w) >= 3} for n in (a, b))
    common = sum(key(w) in {key(v) for v in y} for w in x)
    return common >= 2 or common >= 1 and (len(x) <= 1 or len(y) <= 1)


def test_alike_names_equal_all_pairs(spark):
    rng = random.Random(2)
    words = ["amazon", "amazonia", "prime", "video", "music", "spotify", "ab", "gym", "gymnasium", "north", "cafe", "one", "corner shop"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))).upper() for _ in range(60)} | {"CORNER COFFEE SHOP OLD", "CORNER COFFEE SHOP OLDE", "AB", "AB AB"})
    rows = [(u, n) for n in names for u in (1, 2) if (len(n) + u) % 3]
    got = {tuple(r) for r in clusters.alike(spark.createDataFrame([*rows, (1, None), (1, " ")], "user_id bigint, merchant string")).collect()}
    pairs = [(a, b) for a in names for b in names if a < b]
    scored = spark.createDataFrame(pairs, "a string, b string").select("a", "b", clean_merchant(F.col("a")).alias("x"), clean_merchant(F.col("b")).alias("y"))
    close = {(r.a, r.b) for r in scored.where(F.greatest(fuzzy_score(F.col("x"), F.col("y")), fuzzy_score(F.col("y"), F.col("x"))) >= 0.9).collect()}
    want = {(u, a, b) for a, b in pairs if words_alike(a, b) or (a, b) in close for u in (1, 2) if (u, a) in rows and (u, b) in rows}
    assert got == want and any(not words_alike(a, b) for _, a, b in got)


COLUMNS = "transaction_id string, user_id bigint, merchant_name string, description string, amount decimal(19,2), transaction_date date, category_primary string, category_detailed string"


def found(spark, *groups):
    rows = [(f"{g}-{i}", 1, m, "x", -D(price), d, "subscriptions", None) for g, (m, price, days) in enumerate(groups) for i, d in enumerate(days)]
    return {(r.merchant, float(r.price)): (r.frequency, r.n) for r in subscriptions.detect(spark.createDataFrame(rows, COLUMNS)).collect()}


def test_frequencies_of_uneven_gaps_and_irregular_dates(spark):
    firsts = [dt.date(2024, m, 1) for m in (1, 3, 4, 6, 7, 9)]  # gaps of 60, 31, 61, ...: no band, but always on the first
    lasts = [dt.date(2024, m, d) for m, d in ((1, 31), (2, 29), (5, 30), (7, 29))]
    drifting = [dt.date(2024, 1, 5) + dt.timedelta(days=30 * k) for k in range(6, 12)]  # the median gap is monthly, the days are not near one
    mondays = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * k) for k in range(8)]
    wandering = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * k + k % 2) for k in range(8)]
    yearly = [dt.date(2022, 12, 30), dt.date(2024, 1, 2)]
    got = found(spark, ("Alfa", "1", firsts), ("Bravo", "2", lasts), ("Charlie", "3", drifting), ("Delta", "4", mondays), ("Echo", "5", wandering), ("Foxtrot", "6", yearly))
    assert got == {("alfa", 1.0): ("MONTHLY", 6), ("bravo", 2.0): ("MONTHLY", 4), ("delta", 4.0): ("WEEKLY", 8), ("foxtrot", 6.0): ("ANNUAL", 2)}


def test_alike_merchants_are_one_subscription(spark):
    days = [dt.date(2024, m, 5) for m in range(1, 9)]
    assert found(spark, ("Netflix", "10", days[::2]), ("NETFLIX.COM", "10", days[1::2]), ("Hulu", "10", days[:4])) == {("netflix", 10.0): ("MONTHLY", 8), ("hulu", 10.0): ("MONTHLY", 4)}
