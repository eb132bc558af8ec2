"""Registered queries of operators.steps: orders as imported rows, each with one of the texts below."""

import re

from pyspark.sql import functions as F

from ledgerlake.operators import steps as S
from ledgerlake.registry import register

#: description, merchant, imported category, channel, sign of the amount, account, type. One row and more for each step, and rows near a step.
SAMPLES = [
    ("counter credit", None, "ACH_CREDIT", "ach", 1, "checking", None),
    ("counter credit", None, "ACH_CREDIT", "ach", -1, "checking", None),
    ("Annual rent of SAFE DEPOSIT BOX 12", "First Bank", None, None, -1, "checking", None),
    ("luggage cart gate 4", "City Airport", None, None, -1, "checking", None),
    ("ATM WITHDRAWAL 0042", None, "food", "atm", -1, "checking", None),
    ("credit card cash advance", None, None, None, -1, "creditCard", None),
    ("CHECK # 1021", None, None, None, -1, "checking", None),
    ("check # 7 to checking", None, None, None, -1, "checking", None),
    ("cable tv may", "Harbour Broadband", None, None, -1, "checking", None),
    ("family plan", "Wireless World", None, None, -1, "checking", None),
    ("family plan", "Wirelessly", "dining", None, -1, "checking", None),
    ("county electric BILL PAY", None, None, None, -1, "checking", None),
    ("county electric", None, "groceries", None, -1, "checking", None),
    ("interest earned", None, None, None, 1, "rothIra", None),
    ("interest earned", None, None, None, 1, "savings", None),
    ("certificate interest", None, "food court", None, 1, "savings", None),
    ("dividend quarter 2", None, None, None, 1, "investment", None),
    ("dividend quarter 2", None, None, None, 1, "checking", None),
    ("E-PAYMENT thank you", None, None, None, -1, "checking", None),
    ("mortgage escrow", None, None, None, -1, "checking", None),
    ("loan payment water bill", None, None, None, -1, "checking", None),
    ("mortgage june", None, None, None, -1, "checking", None),
    ("transfer", "Brokerage One", None, None, -1, "checking", None),
    ("advisory fee", None, None, None, -1, "401k", None),
    ("contribution june", None, None, None, -1, "hsa", None),
    ("fund redemption", None, None, None, 1, "529", None),
    ("deposit from", "Brokerage One", None, None, 1, "checking", None),
    ("online transfer to savings", None, None, None, -1, "checking", None),
    ("graduate stipend", None, None, None, 1, "checking", "INCOME"),
    ("graduate stipend", None, None, None, 1, "checking", "EXPENSE"),
    ("rental income flat 3", None, None, None, 1, "checking", "income"),
    ("gratuity pool", None, None, None, 1, "checking", "income"),
    ("PAYROLL JUNE", None, None, "ACH", 1, "checking", None),
    ("payroll reversal", None, None, "ACH", -1, "checking", None),
    ("county property tax", None, None, None, -1, "checking", None),
    ("restricted stock release", None, None, None, 1, "checking", None),
    ("subscription", "The Daily News", None, None, -1, "checking", None),
    ("two nights", "Lakeside HOTEL", None, None, -1, "checking", None),
    ("taxi membership", None, None, None, -1, "checking", None),
    ("taxi to the station", None, None, None, -1, "checking", None),
    ("gas station 12", None, None, None, -1, "checking", None),
    ("POS* lunch", None, None, None, -1, "checking", None),
    ("coffee", "Corner", None, None, -1, "checking", None),
    ("coffeehouse", "Corner", "Food & drink", None, -1, "checking", None),
    ("level 2", "Central Garage", None, None, -1, "checking", None),
    ("monthly", "Old Mill Gym", None, None, -1, "checking", None),
    ("novels", "Bookstore", None, None, -1, "checking", None),
    ("grocery and bookstore", None, None, None, -1, "checking", None),
    ("table 4", "Bakery Lane", None, None, -1, "checking", None),
    ("VETERINARY visit", None, None, None, -1, "checking", None),
    ("software licence", None, None, None, -1, "checking", None),
    ("hair salon", None, None, None, -1, "checking", None),
    ("hardware store", None, None, None, -1, "checking", None),
    ("tuition autumn", None, None, None, -1, "checking", None),
    ("donation", "Relief Fund", None, None, -1, "checking", None),
    ("donation to high school", None, "other", None, -1, "checking", None),
    ("bridge toll", None, None, None, -1, "checking", None),
    ("exam fee", None, None, None, -1, "checking", None),
    ("cinema", None, None, None, -1, "checking", None),
    ("home insurance", None, None, None, -1, "checking", None),
    ("gift shop", None, None, None, -1, "checking", None),
    ("correction of may", None, None, None, 0, "checking", None),
    ("transfer", None, None, None, 0, "checking", None),
    ("unknown", None, None, "ach", 1, "checking", None),
    ("unknown", None, "Food & drink", None, -1, "checking", None),
    ("unknown", None, "seafood", None, -1, "checking", None),
    ("unknown", None, "Dining out", None, -1, "checking", None),
    (None, None, None, None, None, None, None),
]
_SCHEMA = "place int, description string, merchant string, category string, channel string, sign int, account string, kind string"


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _sql() -> str:
    """The steps as one CASE over patterns: another way than the automaton's."""
    texts = {"description": "lower(trim(coalesce(description, '')))", "merchant": "lower(trim(coalesce(merchant, '')))", "category": "lower(trim(coalesce(category, '')))", "channel": "lower(trim(coalesce(channel, '')))"}
    cases = []
    for s in S.read_steps():
        fields = [texts[f] for f in s.get("in", ["description", "merchant"])]
        edge = ("(^|[^a-z0-9])", "($|[^a-z0-9])") if s.get("whole") else ("", "")

        def occurs(words: list[str], fields=fields, edge=edge) -> str:
            pattern = edge[0] + "(" + "|".join(re.sub(r"([*+.?()|\[\]])", r"\\\1", w) for w in words) + ")" + edge[1]
            return "(" + " OR ".join(f"regexp_matches({f}, {_literal(pattern)})" for f in fields) + ")"

        rule = [occurs(s["words"])] + ([occurs(s["also"])] if "also" in s else []) + ([f"NOT {occurs(s['without'])}"] if "without" in s else [])
        rule += [{"in": "sign > 0", "out": "sign < 0", "zero": "sign = 0"}[s["amount"]]] if "amount" in s else []
        rule += ["regexp_matches(lower(account), 'investment|ira|401k|hsa|529')"] if s.get("account") == "investment" else []
        rule += ["lower(kind) = 'income'"] if "type" in s else []
        cases.append((" AND ".join(rule), s["name"], s["category"]))
    rows = ", ".join(f"({i}, {', '.join(map(_literal, r))})" for i, r in enumerate(SAMPLES))
    case = lambda k, other: "CASE " + " ".join(f"WHEN {c[0]} THEN {_literal(c[k])}" for c in cases) + f" ELSE {other} END"
    return f"WITH sa(place, description, merchant, category, channel, sign, account, kind) AS (VALUES {rows}) SELECT o_orderkey AS row_id, {case(1, 'NULL')} AS step, {case(2, _literal('other'))} AS step_category FROM orders JOIN sa ON place = o_orderkey % {len(SAMPLES)}"


@register("c11_import_steps", "row_id l, step s, step_category s", sql=_sql())
def _(spark, sf_dir):
    samples = spark.createDataFrame([(i, *r) for i, r in enumerate(SAMPLES)], _SCHEMA)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_id")).join(F.broadcast(samples), F.col("row_id") % len(SAMPLES) == F.col("place"))
    return S.decide(rows, S.read_steps(), *[F.col(c) for c in ("description", "merchant", "category", "channel", "sign", "account", "kind")])
