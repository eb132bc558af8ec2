"""Registered query of sources.templates: a customer's orders of a year as a statement of one of three issuers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.registry import register
from ledgerlake.sources.templates import statement_records

_ORDERS = """
SELECT CAST(o_custkey AS {text}) || '-' || CAST(year(CAST(o_orderdate AS DATE)) AS {text}) AS doc_id, o_custkey % 3 AS issuer, o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(12,2)) AS price, o_orderstatus = 'F' AS paid,
       CAST(100 + 100000000 * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END + 4 * row_number() OVER (PARTITION BY o_custkey, year(CAST(o_orderdate AS DATE)), o_orderstatus = 'F' ORDER BY o_orderkey) AS INT) AS line_no FROM {orders}"""


def _lines(spark, sf_dir):
    """doc_id, line_no, line: heads, sections, first lines, more lines, foreign amounts and closing lines.

    Orders are read and shuffled once, by customer and year; each gives its own lines, and the first of a document the document's.
    """
    key, paid = F.col("o_orderkey"), F.col("paid")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("price"), (F.col("o_orderstatus") == "F").alias("paid"))
    dealt = orders.withColumn("year", F.year("d")).repartition("o_custkey", "year")
    section = Window.partitionBy("o_custkey", "year", "paid").orderBy("o_orderkey")
    doc = Window.partitionBy("o_custkey", "year").orderBy("paid", "o_orderkey")
    numbered = dealt.withColumn("line_no", (100 + 100000000 * F.when(paid, 1).otherwise(0) + 4 * F.row_number().over(section)).cast("int"))
    rows = numbered.withColumn("last", F.max("line_no").over(doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("place", F.row_number().over(doc))
    issuer, price, text, year = F.col("o_custkey") % 3, F.col("price"), F.concat(F.lit("ORDER "), key.cast("string")), F.col("year").cast("string")
    by_issuer = lambda a, b, c: F.when(issuer == 0, a).when(issuer == 1, b).otherwise(c)
    signed = F.concat(F.when(paid, "").otherwise("-"), F.replace(price, F.lit("."), F.lit(",")))
    start = by_issuer(
        F.concat(F.date_format("d", "MM/dd"), F.lit("  "), text, F.lit("   $"), price, F.when(paid, " CR").otherwise("")),
        F.concat_ws(" ", F.date_format("d", "dd.MM.yyyy"), text, signed),
        F.concat_ws(" ", F.date_format("d", "MM-dd"), price, text),
    )
    first, line_no, last = F.col("place") == 1, F.col("line_no"), F.col("last")
    line = lambda when, number, text: F.when(when, F.struct(number.cast("int").alias("line_no"), text.alias("line")))
    lines = F.array(
        line(first, F.lit(0), by_issuer(F.lit("Harbour Card Services"), F.lit("Lindenbank Kontoauszug"), F.lit("FIRST PRAIRIE BANK"))),
        line(first, F.lit(1), by_issuer(F.concat(F.lit("Closing date: 12/31/"), year), F.concat(F.lit("bis 31.12."), year), F.concat(F.lit("through Dec 31, "), year))),
        line(first & (issuer == 2), F.lit(50), F.lit("WITHDRAWALS")),
        line(first & (issuer == 2), F.lit(100000050), F.lit("DEPOSITS")),
        line(F.lit(True), line_no, start),
        line((issuer == 0) & (key % 5 == 0), line_no + 1, F.lit("  EUR 12.50 @ 1.1")),
        line(key % 4 == 0, line_no + 2, F.lit("    second line")),
        line(first, last + 3, by_issuer(F.lit("Total"), F.lit("Saldo"), F.lit("ENDING BALANCE"))),
        line(first, last + 4, F.lit("    after the end")),
    )
    doc_id = F.concat(F.col("o_custkey").cast("string"), F.lit("-"), year).alias("doc_id")
    return rows.select(doc_id, F.explode(lines).alias("l")).where("l IS NOT NULL").select("doc_id", "l.line_no", "l.line")


@register("s17_statement_records", "doc_id s, line_no l, issuer s, transaction_date d, description s, amount m, foreign_currency s, foreign_amount m, rate f", sql=f"""
WITH r AS ({_ORDERS.format(text='VARCHAR', orders='orders')})
SELECT doc_id, line_no, CASE issuer WHEN 0 THEN 'Harbour Card' WHEN 1 THEN 'Lindenbank' ELSE 'First Prairie' END AS issuer, d AS transaction_date, 'ORDER ' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN ' second line' ELSE '' END AS description, CASE WHEN paid THEN price ELSE -price END AS amount,
       CASE WHEN issuer = 0 AND o_orderkey % 5 = 0 THEN 'EUR' END AS foreign_currency, CASE WHEN issuer = 0 AND o_orderkey % 5 = 0 THEN 12.5 END AS foreign_amount, CASE WHEN issuer = 0 AND o_orderkey % 5 = 0 THEN 1.1 END AS rate FROM r""")
def _(spark, sf_dir):
    return statement_records(_lines(spark, sf_dir))
