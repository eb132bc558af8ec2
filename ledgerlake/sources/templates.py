"""Transactions of statement texts by issuer templates (row S17): records of one or more lines, foreign amounts, sign conventions.

Templates are rows of a file (`read_templates`). A document has the first template whose marker is on one of its lines; documents without are left out. A
record starts at a line of the template's start pattern; a running sum of starts gives each line its record, and the lines after a start add to its
text or tell its foreign amount, until a closing line, a section or a page. Sections set the sign of the records below them. Dates without a year take
that of the statement's closing day, or the one before where their month is later in the year.

Lines are read and shuffled once, by document; a document is one sorted run of lines, never a list. Defined results: null and empty lines close nothing and add
nothing; a date that is none, or an amount that is none, makes no record; a statement without closing day keeps the dates that have a year of their own; very
long lines are read whole; repeated documents must differ in doc_id.
"""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlake.sources.files import parse_amount

STARTER = str(Path(__file__).parent.parent / "rules" / "statement_templates.toml")
KEYS = {"issuer", "marker", "period", "period_date", "date", "start", "more", "foreign", "end", "sign", "credit", "section"}


def read_templates(path: str = STARTER) -> list[dict]:
    """The templates of a file, in order, checked: each has an issuer, a marker, a date form and a start with its three groups."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("template", [])
    for t in found:
        if set(t) - KEYS or not {"issuer", "marker", "date", "start"} <= set(t) or {"date", "text", "amount"} - set(groups(t["start"])):
            raise ValueError(f"not a template: {t.get('issuer', t)}")
    return found


def groups(pattern: str) -> dict[str, int]:
    """Numbers of a pattern's named groups, among all its groups."""
    opening = [m for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|\((?!\?)|\(\?<(?![=!])(\w+)>", pattern) if m[0][0] == "("]
    return {m[1]: i for i, m in enumerate(opening, 1) if m[1]}


def _group(pattern: str, name: str) -> Column:
    found = groups(pattern)
    return F.regexp_extract("line", pattern, found[name]) if name in found else F.lit(None).cast("string")


def _by_template(templates: list[dict], make) -> Column:
    """make(template) of the row's template."""
    out = F.lit(None)
    for i, t in enumerate(templates):
        out = F.when(F.col("template") == i, make(t)).otherwise(out)
    return out


def _in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def _with_template(lines: DataFrame, templates: list[dict]) -> DataFrame:
    """Lines with the number of their document's template and the day on which it closes."""
    # Ordered, as the windows over the lines' records are, so that lines are sorted once.
    whole = _in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(templates))):
        first = F.when(F.col("line").rlike(t["marker"]), i).otherwise(first)
    days = [F.try_to_date(F.when(F.col("line").rlike(t["period"]), F.regexp_extract("line", t["period"], 1)), t.get("period_date", t["date"])) if "period" in t else F.lit(None).cast("date") for t in templates]
    marked = lines.where("doc_id IS NOT NULL").select("*", first.alias("template"), *[d.alias(f"day{i}") for i, d in enumerate(days)])
    told = marked.select("doc_id", "line_no", "line", F.min("template").over(whole).alias("template"), *[F.max(f"day{i}").over(whole).alias(f"day{i}") for i in range(len(days))])
    return told.where("template IS NOT NULL").select("doc_id", "line_no", "line", "template", _by_template(templates, lambda t: F.col(f"day{templates.index(t)}")).alias("closes"))


def _dated(form: str, closes: Column) -> Column:
    """The column `day` as a date."""
    if "y" in form:
        return F.try_to_date("day", form)
    this, last = (F.try_to_date(F.concat_ws(" ", "day", year.cast("string")), f"{form} yyyy") for year in (F.year(closes), F.year(closes) - 1))
    # The 29th of February is a date in one of the two years only.
    return F.when(closes.isNotNull() & F.col("day").isNotNull(), F.when(this.isNull() | (F.month(this) > F.month(closes)), last).otherwise(this))


def statement_records(lines: DataFrame, templates: list[dict] | None = None) -> DataFrame:
    """doc_id, line_no, issuer, transaction_date, description, amount, foreign_currency, foreign_amount, rate of lines(doc_id, line_no, line)."""
    templates = read_templates() if templates is None else templates
    schema = "doc_id string, line_no int, issuer string, transaction_date date, description string, amount decimal(19,2), foreign_currency string, foreign_amount decimal(19,2), rate double"
    if not templates:
        return lines.sparkSession.createDataFrame([], schema)
    known = _with_template(lines.select("doc_id", "line_no", F.coalesce("line", F.lit("")).alias("line")), templates)
    of = lambda make: _by_template(templates, make)
    is_a = lambda t, key: F.col("line").rlike(t[key]) if key in t else F.lit(False)
    text = lambda key: of(lambda t: F.trim(_group(t["start"], key)))

    def section(t: dict) -> Column:
        out = F.lit(None).cast("int")
        for s in reversed(t.get("section", [])):
            out = F.when(F.col("line").rlike(s["line"]), s["sign"]).otherwise(out)
        return out

    def credited(t: dict) -> Column:
        return F.col("printed").endswith(t["credit"]) if t.get("credit") else F.lit(False)

    order = _in_order()
    starts = of(lambda t: is_a(t, "start"))
    marked = known.select("doc_id", "line_no", "line", "template", "closes", starts.alias("starts"), of(section).alias("section"), of(lambda t: is_a(t, "end")).alias("ends"), of(lambda t: is_a(t, "foreign")).alias("foreign"), of(lambda t: is_a(t, "more")).alias("more"))
    # A closing line or a section opens a part without a start, to which nothing is added.
    opens = F.col("starts") | F.col("ends") | F.col("section").isNotNull()
    placed = marked.withColumn("record", F.sum(opens.cast("int")).over(order)).withColumn("signed", F.last("section", ignorenulls=True).over(order))
    useful = placed.where(F.col("starts") | F.col("foreign") | F.col("more"))
    is_foreign, is_more = ~F.col("starts") & F.col("foreign"), ~F.col("starts") & ~F.col("foreign") & F.col("more")
    foreign = lambda name: F.when(is_foreign, of(lambda t: _group(t.get("foreign", ""), name)))
    words = F.when(F.col("starts"), text("text")).when(is_more, of(lambda t: F.trim(_group(t.get("more", ""), "text"))))
    # Cut out first, then read while grouping: what is used several times is a column, so that it is computed once, in stages small enough to be compiled.
    sign = F.when(F.col("starts"), F.coalesce("signed", of(lambda t: F.lit(t.get("sign", 1)))))
    cut = useful.select("doc_id", "record", "line_no", "template", "closes", "starts", sign.alias("sign"), words.alias("words"),
        F.when(F.col("starts"), of(lambda t: _group(t["start"], "date"))).alias("day"), F.when(F.col("starts"), text("amount")).alias("printed"),
        F.when(is_foreign, F.struct("line_no", foreign("currency").alias("currency"), foreign("amount").alias("amount"), foreign("rate").alias("rate"))).alias("foreign"))
    cut = cut.withColumn("credited", of(credited))
    plain = F.when(F.col("credited"), of(lambda t: F.replace("printed", F.lit(t.get("credit", "")), F.lit("")))).otherwise(F.col("printed"))
    cut = cut.withColumn("plain", plain).withColumn("sign", F.when(F.col("credited"), -F.col("sign")).otherwise(F.col("sign")))
    records = cut.groupBy("doc_id", "record").agg(
        F.max(F.when(F.col("starts"), F.col("line_no"))).alias("line_no"),
        F.max(of(lambda t: F.lit(t["issuer"]))).alias("issuer"),
        F.max(of(lambda t: _dated(t["date"], F.col("closes")))).alias("transaction_date"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("words").isNotNull(), F.struct("line_no", "words")))), lambda w: w["words"]), " ").alias("description"),
        F.max(parse_amount(F.col("plain")) * F.col("sign")).cast("decimal(19,2)").alias("amount"),
        F.min("foreign").alias("foreign"),
    )
    kept = records.where("line_no IS NOT NULL AND transaction_date IS NOT NULL AND amount IS NOT NULL")
    return kept.select("doc_id", "line_no", "issuer", "transaction_date", "description", "amount", F.nullif("foreign.currency", F.lit("")).alias("foreign_currency"), parse_amount(F.col("foreign.amount")).alias("foreign_amount"), F.expr("try_cast(foreign.rate AS double)").alias("rate"))
