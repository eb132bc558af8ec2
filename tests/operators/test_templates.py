import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerlake.sources import templates

HARBOUR = """Harbour Card Services
Opening date 12/06/2023  Closing date: 01/05/2024
Date  Description  Amount
12/28  CORNER CAFE  SPRINGFIELD   $1,012.50
  store 12 second floor
01/03  PARIS BOOKS          21.70
  EUR 20.00 @ 1.085
  livres anciens
01/04  PAYMENT THANK YOU   $300.00 CR
Total for this period  $734.20
  not a continuation
02/30  NO SUCH DAY  1.00
01/05  REFUND  -5.00"""
LINDEN = """Lindenbank Kontoauszug
vom 01.02.2024 bis 29.02.2024
29.02.2024 Miete Lindenweg -1.250,00
    Verwendungszweck Februar
    Ref 77
28.02.2024 Gehalt 3.000,50
Saldo 1.750,50
    zu Ende"""
PRAIRIE = """FIRST PRAIRIE BANK
Statement of Feb 1, 2024 through Mar 1, 2024
BEGINNING BALANCE 10.00
DEPOSITS AND CREDITS
02-29 50.00 COUNTER DEPOSIT
WITHDRAWALS
03-01 20.00 ATM MAIN STREET
  CARD 1234
12-31 5.00 LATE FEE
ENDING BALANCE 35.00
  trailing"""


def records(spark, docs, listed=None):
    rows = [(d, i, line) for d, text in docs.items() for i, line in enumerate(text.split("\n"))] + [("null", 0, None)]
    out = templates.statement_records(spark.createDataFrame(rows, "doc_id string, line_no int, line string"), listed)
    return sorted(tuple(r) for r in out.collect())


def test_three_issuers(spark):
    got = records(spark, {"h": HARBOUR, "l": LINDEN, "p": PRAIRIE, "x": "01/02  UNKNOWN ISSUER  9.00", "e": ""})
    day = dt.date
    assert got == [
        ("h", 3, "Harbour Card", day(2023, 12, 28), "CORNER CAFE  SPRINGFIELD store 12 second floor", D("-1012.50"), None, None, None),
        ("h", 5, "Harbour Card", day(2024, 1, 3), "PARIS BOOKS livres anciens", D("-21.70"), "EUR", D("20.00"), 1.085),
        ("h", 8, "Harbour Card", day(2024, 1, 4), "PAYMENT THANK YOU", D("300.00"), None, None, None),
        ("h", 12, "Harbour Card", day(2024, 1, 5), "REFUND", D("5.00"), None, None, None),
        ("l", 2, "Lindenbank", day(2024, 2, 29), "Miete Lindenweg Verwendungszweck Februar Ref 77", D("-1250.00"), None, None, None),
        ("l", 5, "Lindenbank", day(2024, 2, 28), "Gehalt", D("3000.50"), None, None, None),
        ("p", 4, "First Prairie", day(2024, 2, 29), "COUNTER DEPOSIT", D("50.00"), None, None, None),
        ("p", 6, "First Prairie", day(2024, 3, 1), "ATM MAIN STREET CARD 1234", D("-20.00"), None, None, None),
        ("p", 8, "First Prairie", day(2023, 12, 31), "LATE FEE", D("-5.00"), None, None, None),
    ]


def test_a_statement_without_closing_day_and_no_templates(spark):
    assert records(spark, {"h": "Harbour Card Services\n01/03  TEA  1.00", "l": "Lindenbank Kontoauszug\n01.02.2024 Tee -1,00"}) == [("l", 1, "Lindenbank", dt.date(2024, 2, 1), "Tee", D("-1.00"), None, None, None)]
    assert records(spark, {"h": HARBOUR}, []) == []


def test_templates_are_checked(tmp_path):
    path = tmp_path / "t.toml"
    path.write_text("[[template]]\nissuer = 'x'\nmarker = 'y'\ndate = 'MM/dd'\nstart = '(?<date>.) (?<amount>.)'\n")
    with pytest.raises(ValueError, match="not a template"):
        templates.read_templates(str(path))
    assert templates.groups(r"(a)\((?<b>[(]x)(?:c)(?<d>e(f))") == {"b": 2, "d": 3}


def test_lines_are_read_and_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([("h", 0, HARBOUR.split("\n")[0])], "doc_id string, line_no int, line string").write.parquet(path)
    plan = templates.statement_records(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange") == plan.count("FileScan") == 1 and "Join" not in plan


def test_statement_queries_read_orders_once(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["s17_statement_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
