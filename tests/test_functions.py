from decimal import Decimal as D

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import dates, money, text
from ledgerlake.operators import recurrence
from ledgerlake.sources import files


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("(1,234.56)", "-1234.56"), ("1.234,56", "1234.56"), ("-$5", "-5.00"), ("", None), ("Rs.500", "500.00"), ("12,50", "12.50"), ("$1,000,000,000.00", "999999999.99"), ("abc", None), (".5", "0.50"), ("1,234", "1234.00")],
)
def test_amounts(spark, given, wanted):
    assert one(spark, files.parse_amount(F.lit(given))) == (None if wanted is None else D(wanted))


@pytest.mark.parametrize(("given", "wanted"), [("2024-02-29", "2024-02-29"), ("13/01/2024", "2024-01-13"), ("01/13/2024", "2024-01-13"), ("02/03/2024", "2024-02-03"), ("5 Mar 2024", "2024-03-05"), ("32/01/2024", None), ("2024-02-30", None), ("x", None)])
def test_dates(spark, given, wanted):
    got = one(spark, files.parse_date(F.lit(given)))
    assert (got and str(got)) == wanted


@pytest.mark.parametrize(("t", "h", "f", "wanted"), [("€5", "", "", "EUR"), ("5", "Amount (GBP)", "", "GBP"), ("5", "", "march_inr.csv", "INR"), ("¥5", "", "", "JPY"), ("¥5 RMB", "", "", "CNY"), ("5", "", "", "USD")])
def test_currency(spark, t, h, f, wanted):
    assert one(spark, files.detect_currency(F.lit(t), F.lit(h), F.lit(f))) == wanted


def test_headers():
    assert files.header_names(["﻿Date", "", "Amount", "Amount", " "]) == ["Date", "column2", "Amount", "Amount_2", "column5"]


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Date,Text,Amount,Amount\n2024-01-01,"a, ""b""\nc",5,6\n', encoding="utf-8")
    rows = files.read_any(spark, str(p)).collect()
    assert [r.asDict() for r in rows] == [{"Date": "2024-01-01", "Text": 'a, "b"\nc', "Amount": "5", "Amount_2": "6"}]


def test_statement_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Header\n01/15 COFFEE SHOP  4.50\n  CITY ST\n2024-01-16 REFUND -3.00\n01/17 BIG (1,000.00)\n")
    rows = files.statement_rows(files.read_any(spark, str(tmp_path / "s.txt")), 2024).orderBy("line_no").collect()
    assert [(str(r.transaction_date), r.description, r.amount) for r in rows] == [("2024-01-15", "COFFEE SHOP CITY ST", D("-4.50")), ("2024-01-16", "REFUND", D("-3.00")), ("2024-01-17", "BIG", D("1000.00"))]


@pytest.mark.parametrize(("new", "wanted"), [(105.0, "PASS"), (106.0, "PASS"), (106.5, "FAIL"), (None, "SKIPPED")])
def test_statement_check(spark, new, wanted):
    c = lambda v: F.lit(v).cast("decimal(19,2)")
    assert one(spark, files.statement_check(c(100.0), c(-50.0), c(50.0), c(5.0), c(None), c(new))) == wanted


def test_money_is_half_up(spark):
    dec = lambda s: F.lit(s).cast("decimal(19,4)")
    assert one(spark, money.money(dec("1.005"))) == D("1.01") and one(spark, money.money(dec("-1.005"))) == D("-1.01")
    assert one(spark, money.ratio(F.lit(1), F.lit(0))) == 0 and one(spark, money.ratio(F.lit(1), F.lit(3))) == D("0.3333")
    assert one(spark, money.round_to(dec("47.50"), 5)) == D("50.00") and one(spark, money.ceil_to(dec("45.01"), 5)) == D("50.00")
    assert one(spark, money.round_up_part(dec("-4.30"))) == D("0.70") and one(spark, money.round_up_part(dec("5.00"))) == 0


def test_cents_median(spark):
    df = spark.createDataFrame([(D("1.00"),), (D("1.01"),)], "x decimal(19,2)")
    assert df.agg(money.cents_median(F.col("x")).alias("m")).first().m == D("1.01")


def test_cycles(spark):
    d = F.lit("2024-01-17").cast("date")
    for period, start, end in (("weekly", "2024-01-15", "2024-01-21"), ("BIWEEKLY", "2024-01-15", "2024-01-28"), ("monthly", "2024-01-01", "2024-01-31"), (None, "2024-01-01", "2024-01-31")):
        p = F.lit(period).cast("string")
        assert (str(one(spark, dates.cycle_start(p, d))), str(one(spark, dates.cycle_end(p, d)))) == (start, end)


def test_month_ends_stay_clamped_when_rolled_forward(spark):
    rolled = dates.roll_forward(F.lit("2024-01-31").cast("date"), F.lit("MONTHLY"), F.lit("2024-03-15").cast("date"))
    assert str(one(spark, rolled)) == "2024-03-29"


@pytest.mark.parametrize(("gap", "wanted"), [(7, "WEEKLY"), (14, "BI_WEEKLY"), (30, "MONTHLY"), (91, "QUARTERLY"), (182, "SEMI_ANNUAL"), (365, "ANNUAL"), (50, None), (1, "DAILY")])
def test_frequencies(spark, gap, wanted):
    assert one(spark, recurrence.frequency(F.lit(float(gap)))) == wanted


def test_merchants(spark):
    assert one(spark, text.normalized_merchant(F.lit("pos Streamly.com INC #123 99999 *x"))) == "STREAMLY X"
    assert one(spark, text.merchant_key(F.lit(" Ab-C 1! "))) == "abc1"
    assert text.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and text.jaro_winkler("", "a") == 0
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.7071, abs=1e-4)


def test_workbooks(spark, tmp_path):
    import zipfile

    sheet = '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>Da</t><t>te</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    rows = files.read_any(spark, str(tmp_path / "b.xlsx")).collect()
    assert [(r.sheet, r.row_no, r["cells"]) for r in rows] == [("sheet1", 1, ["Date", "", "2.5"]), ("sheet1", 3, ["", "in"])]


def test_jaro_winkler_rounds_transpositions_down(spark):
    """Three characters in another order are one transposition, as DuckDB counts them."""
    pairs = [("abcdef", "bcadef"), ("old plate brand#15 standard", "old ring brand#12 standard"), ("cold gear", "gold race"), ("hot ring brand#24 small", "hot bolt brand#12 small")]
    rows = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    want = [r[0] for r in duckdb.sql(f"SELECT jaro_winkler_similarity(a, b) FROM (VALUES {rows}) AS t(a, b)").fetchall()]
    assert [text.jaro_winkler(a, b) for a, b in pairs] == pytest.approx(want, abs=1e-12)
    assert text.jaro_winkler("abcdef", "bcadef") == pytest.approx((1 + 1 + 5 / 6) / 3)
