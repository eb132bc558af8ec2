"""Registered orders of findings (rows O03 to O06, O08, O10): the place of each among its user's."""

from ledgerlake.operators.overview import ranked
from ledgerlake.plans import aggregates, budgets, forecasts, recurrence, subscriptions  # noqa: F401  (their queries are ordered here)
from ledgerlake.registry import query_of, register, sql_of

#: Name -> the query whose rows are ordered, its columns, and the order: (column, descending), up to a total order.
ORDERS = {
    "o03_bills_by_due": ("d13_upcoming_bills", "user_id l, merchant s, amount m, due d", (("due", False), ("merchant", False), ("amount", False))),
    "o04_suggestions_by_limit": ("b06_suggestions", "user_id l, category s, recommended m", (("recommended", True), ("category", False))),
    "o05_renewals_by_day": ("d26_renewals", "user_id l, subscription_id s, days_until l", (("days_until", False), ("subscription_id", False))),
    "o06_goals_by_probability": ("x05_goal_probability", "user_id l, goal_id s, probability f", (("probability", True), ("goal_id", False))),
    "o06_accounts_by_interest": ("x07_interest_forecast", "user_id l, account_id l, annual_interest f", (("annual_interest", True), ("account_id", False))),
    "o08_cuts_by_amount": ("x04_predicted_cuts", "user_id l, name s, kind s, value f", (("value", True), ("name", False), ("kind", False))),
    "o10_categories_by_density": ("a11_category_density", "user_id l, category s, monthly m", (("monthly", True), ("category", False))),
}


def _register(name: str, base: str, columns: str, order: tuple) -> None:
    by = ", ".join(f"{c} {'DESC' if descending else 'ASC'} NULLS LAST" for c, descending in order)

    @register(name, columns + ", place l", sql=f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {by}) AS place FROM ({sql_of(base)})")
    def _(spark, sf_dir):
        return ranked(query_of(base)(spark, sf_dir), *order)


for _name, _row in ORDERS.items():
    _register(_name, *_row)
