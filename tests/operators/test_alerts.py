import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerlake.streaming import alerts

TX = "transaction_id string, user_id bigint, category_primary string, category_detailed string, amount decimal(19,2), transaction_date date"
BUDGET = "budget_id string, user_id bigint, category string, period string, monthly_limit decimal(19,2), carried_amount decimal(19,2), last_alerted_threshold int"


@pytest.mark.parametrize(
    ("points", "last", "wanted"),
    [(4999, 0, (0, 0)), (5000, 0, (50, 50)), (10000, 50, (100, 100)), (8000, 90, (75, 90)), (7499, 90, (50, 50)), (8999, 100, (75, 75)), (10, 50, (0, 50))],
)
def test_bookmarks(points, last, wanted):
    assert alerts.bookmark(points, last) == wanted


def test_each_threshold_alerts_once_over_micro_batches(spark, tmp_path):
    spends = [("49.99", 3), ("0.01", 4), ("30", 5), ("-60", 6), ("75", 7), ("40", 8), ("60", 35)]  # the last is next month's
    for k, (amount, day) in enumerate(spends):
        row = (f"t{k}", 1, "dining", "dining", -D(amount), dt.date(2024, 1, 1) + dt.timedelta(day))
        other = (f"o{k}", 2, "travel", None, D("-500"), dt.date(2024, 1, 2))
        spark.createDataFrame([row, other], TX).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    budgets = spark.createDataFrame([("b", 1, "dining", "monthly", D("90"), D("10"), 0), ("z", 2, "dining", "monthly", D("1"), D("0"), 0)], BUDGET)
    stream = spark.readStream.schema(TX).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = alerts.threshold_alerts(stream, budgets).writeStream.format("memory").queryName("budget_alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted((r.cycle_start.month, r.spent_cents, r.threshold) for r in spark.table("budget_alerts").collect())
    # 50, 80, then back to 20 (the bookmark falls), 95 and 135
    assert got == [(1, 5000, 50), (1, 8000, 75), (1, 9500, 90), (1, 13500, 100), (2, 6000, 50)]
