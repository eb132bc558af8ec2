"""Files that people hand in: CSV exports and statement texts (rows S14, S15, S17, S18, F12 to F14, F38)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Currency marks.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY"}
CODES = ("USD", "EUR", "GBP", "INR", "JPY", "CNY", "CAD", "AUD", "CHF")


def header_names(names: list[str]) -> list[str]:
    """Blank headers become columnN, repeated ones get _2, _3 and so on."""
    seen: Counter = Counter()
    out = []
    for i, n in enumerate(names, 1):
        n = n.strip().lstrip("﻿") or f"column{i}"
        seen[n] += 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; quotes are doubled inside quotes, and quoted fields may hold commas and line ends."""
    raw = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding)
    head = raw.csv(path).first()
    if head is None:
        return spark.createDataFrame([], "column1 string")
    names = header_names([x or "" for x in head])
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).csv(path)


def parse_amount(c: Column) -> Column:
    """Text to money: marks go; parentheses or a minus are negative; 1.234,56 and 1,234.56; cut at 999,999,999.99; else null."""
    x = F.regexp_replace(F.trim(c), r"(?i)rs\.?|usd|eur|gbp|inr|jpy|cny|cad|aud|chf|[$€£₹¥\s]", "")
    negative = x.rlike(r"^\(.*\)$") | x.startswith("-") | x.endswith("-")
    x = F.regexp_replace(x, r"[()+-]", "")
    european = x.rlike(r"^\d{1,3}(\.\d{3})*,\d{1,2}$") | x.rlike(r"^\d+,\d{1,2}$")
    plain = F.when(european, F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(x, F.lit(","), F.lit("")))
    value = F.round(plain.try_cast("decimal(24,6)"), 2)
    capped = F.when(value.isNotNull(), F.least(value, F.lit("999999999.99").cast("decimal(24,2)")))
    return F.when(negative, -capped).otherwise(capped).cast("decimal(19,2)")


def parse_date(c: Column) -> Column:
    """ISO first; with slashes a part over 12 is the day, else month comes first; then day-month names."""
    x = F.trim(c)
    a, b = F.regexp_extract(x, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 1), F.regexp_extract(x, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 2)
    y = F.regexp_extract(x, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 3)
    day_first = a.try_cast("int") > 12
    slashes = F.concat_ws("-", y, F.lpad(F.when(day_first, b).otherwise(a), 2, "0"), F.lpad(F.when(day_first, a).otherwise(b), 2, "0"))
    return F.coalesce(F.try_to_date(F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), F.try_to_date(F.when(y != "", slashes), "yyyy-MM-dd"), F.try_to_date(x, "d MMM yyyy"), F.try_to_date(x, "MMM d, yyyy"), F.try_to_date(x, "yyyyMMdd"))


def detect_currency(text: Column, header: Column, file_name: Column) -> Column:
    """By a code or mark in the text, then in the header, then in the file name; a yen mark beside CNY or RMB is yuan; else USD."""

    def one(c: Column) -> Column:
        found = F.when(c.contains("¥") & F.upper(c).rlike("CNY|RMB|CHINA"), "CNY")
        for code in CODES:
            found = found.when(F.upper(c).rlike(rf"\b{code}\b"), code)
        for mark, code in SYMBOLS.items():
            found = found.when(c.contains(mark), code)
        return found

    return F.coalesce(one(text), one(header), one(F.replace(file_name, F.lit("_"), F.lit(" "))), F.lit("USD"))


def merge_debit_credit(credit: Column, debit: Column) -> Column:
    """Two columns to one signed amount."""
    return F.coalesce(F.abs(credit), -F.abs(debit))


#: A statement line: date, description, amount. Templates are rows of (issuer, pattern, sign): sign -1 where charges are printed positive.
TEMPLATES = [
    ("plain", r"^(\d{2}/\d{2}(?:/\d{4})?)\s+(.+?)\s+(\(?-?\$?[\d,]+\.\d{2}\)?)$", -1),
    ("iso", r"^(\d{4}-\d{2}-\d{2})\s+(.+?)\s+(-?[\d,]+\.\d{2})$", 1),
]


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (doc_id, line_no, line)."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("doc_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return rows


def statement_rows(lines: DataFrame, year: int, templates: list = TEMPLATES) -> DataFrame:
    """Transactions of statement lines (doc_id, line_no, line); the first template that fits counts; an indented line without amount continues the one before."""
    fits = F.lit(None)
    for issuer, pattern, sign in reversed(templates):
        found = F.struct(F.lit(issuer).alias("template"), F.regexp_extract("line", pattern, 1).alias("date"), F.regexp_extract("line", pattern, 2).alias("text"), F.regexp_extract("line", pattern, 3).alias("amount"), F.lit(sign).alias("sign"))
        fits = F.when(F.col("line").rlike(pattern), found).otherwise(fits)
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("m", fits).withColumn("next", F.lead(F.struct("line", F.col("m").isNull().alias("free"))).over(order)).where("m IS NOT NULL")
    more = F.when(F.col("next.free") & F.col("next.line").rlike(r"^\s{2,}\S"), F.concat(F.lit(" "), F.trim("next.line"))).otherwise("")
    full = F.when(F.length("m.date") == 5, F.concat(F.col("m.date"), F.lit(f"/{year}"))).otherwise(F.col("m.date"))
    return rows.select("doc_id", "line_no", "m.template", parse_date(full).alias("transaction_date"), F.concat(F.col("m.text"), more).alias("description"), (parse_amount(F.col("m.amount")) * F.col("m.sign")).cast("decimal(19,2)").alias("amount"))


def statement_check(previous: Column, payments: Column, purchases: Column, fees: Column, interest: Column, new: Column) -> Column:
    """PASS if previous - |payments| + purchases + fees + interest is the new balance within 1.00; SKIPPED without both balances."""
    zero = F.lit(0)
    expected = previous - F.abs(F.coalesce(payments, zero)) + F.coalesce(purchases, zero) + F.coalesce(fees, zero) + F.coalesce(interest, zero)
    return F.when(previous.isNull() | new.isNull(), "SKIPPED").when(F.abs(expected - new) <= 1, "PASS").otherwise("FAIL")


#: File kinds and their readers; more are added by assignment.
READERS = {"csv": read_csv, "txt": read_statements}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    return READERS[path.rsplit(".", 1)[-1].lower()](spark, path)


def _cells(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook: a zip archive of XML parts."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    name = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if name(t) == "t")
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = z.namelist()
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts else []
        for part in sorted(p for p in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", p)):
            for row in (e for e in ElementTree.fromstring(z.read(part)).iter() if name(e) == "row"):
                cells: dict[int, str] = {}
                for c in row:
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = 0
                    for ch in letters:
                        at = 26 * at + ord(ch) - 64
                    value = next((v.text or "" for v in c if name(v) == "v"), text(c))
                    cells[at or len(cells) + 1] = shared[int(value)] if c.get("t") == "s" else value
                out.append((part.rsplit("/", 1)[-1][:-4], int(row.get("r", len(out) + 1)), [cells.get(i, "") for i in range(1, max(cells, default=0) + 1)]))
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks as rows (doc_id, sheet, row_no, cells); files are read where Spark puts them, a file a row."""
    import pandas as pd

    def rows(batches):
        for pdf in batches:
            found = [(p, s, r, c) for p, content in zip(pdf.path, pdf.content, strict=True) for s, r, c in _cells(bytes(content))]
            yield pd.DataFrame(found, columns=["doc_id", "sheet", "row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "doc_id string, sheet string, row_no int, cells array<string>")


READERS["xlsx"] = read_workbooks
