"""Budget thresholds as a stream (row T06): the stateful twin of operators.budgets.threshold_crossings.

Transactions of a stream meet the budgets, a static table, by user and category. Each budget and cycle keeps what was spent so far and
its bookmark, the threshold of the last alert; a micro-batch gives an alert where the spend reaches a threshold above the bookmark. Where
refunds bring it more than one threshold below, the bookmark falls back, as in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.dates import cycle_start
from ledgerlake.operators.budgets import THRESHOLDS, by_category

ALERTS = "budget_id string, cycle_start date, spent_cents bigint, percent double, threshold int"


def bookmark(basis_points: int, last: int) -> tuple[int, int]:
    """(threshold reached, new bookmark) for a spend in hundredths of a percent and the last alert's threshold."""
    reached = max((t for t in THRESHOLDS if basis_points >= 100 * t), default=0)
    if reached > last:
        return reached, reached
    lower = [t for t in sorted(THRESHOLDS) if t < last]
    below = lower[-1] if lower else 0
    return reached, reached if basis_points < 100 * below else last


def threshold_alerts(tx: DataFrame, budgets: DataFrame) -> DataFrame:
    """One row for each alert: budget, cycle, what was spent by then (cents, not under 0), its percentage and the threshold."""
    b = budgets.select("budget_id", F.col("user_id").alias("b_user"), F.col("category").alias("b_category"), "period", ((F.col("monthly_limit") + F.col("carried_amount")) * 100).cast("bigint").alias("limit_cents"), F.col("last_alerted_threshold").alias("first_mark"))
    rows = by_category(tx.select("user_id", "category_primary", "category_detailed", "transaction_date", (-F.col("amount") * 100).cast("bigint").alias("cents")))
    joined = rows.join(b, (F.col("user_id") == F.col("b_user")) & (F.col("category") == F.col("b_category"))).where("limit_cents > 0")
    joined = joined.select("budget_id", cycle_start(F.col("period"), F.col("transaction_date")).alias("cycle_start"), "cents", "limit_cents", "first_mark")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames))
        limit = int(pdf.limit_cents.iloc[0])
        spent, mark = state.get if state.exists else (0, int(pdf.first_mark.iloc[0] or 0))
        spent += int(pdf.cents.sum())
        shown = max(spent, 0)
        points = (20_000 * shown + limit) // (2 * limit)  # half up
        reached, now = bookmark(points, mark)
        state.update((spent, now))
        alert = [(key[0], key[1], shown, points / 100, reached)] if reached > mark else []
        yield pd.DataFrame(alert, columns=["budget_id", "cycle_start", "spent_cents", "percent", "threshold"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return joined.groupBy("budget_id", "cycle_start").applyInPandasWithState(step, ALERTS, "spent bigint, mark int", "append", GroupStateTimeout.NoTimeout)
