"""Keyed scans, incremental reads and sinks over canonical frames (rows S01 to S13, S20, S21, S23). Filters reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.dates import day
from ledgerlake.functions.filters import between, not_deleted


def deduplicated(tx: DataFrame) -> DataFrame:
    """One row a transaction_id, then one a bank-feed id (where there is one): the first by date and id."""
    by_id = Window.partitionBy("transaction_id").orderBy("transaction_date", "updated_at_ts")
    one = tx.withColumn("r", F.row_number().over(by_id)).where("r = 1").drop("r")
    fed = F.col("plaid_transaction_id").isNotNull() & (F.col("plaid_transaction_id") != "")
    by_feed = Window.partitionBy("plaid_transaction_id").orderBy("transaction_date", "transaction_id")
    return one.where(~F.coalesce(fed, F.lit(False))).unionByName(one.where(fed).withColumn("r", F.row_number().over(by_feed)).where("r = 1").drop("r"))


def _of_user(tx: DataFrame, user_id: int | None) -> DataFrame:
    return tx if user_id is None else tx.where(F.col("user_id") == user_id)


def user_range(tx: DataFrame, start: str, end: str, user_id: int | None = None) -> DataFrame:
    """Each user's rows (or one user's) between two days, both included, without repeats. All rows come; there is no cap."""
    return deduplicated(_of_user(tx, user_id).where(between("transaction_date", start, end)))


def user_page(tx: DataFrame, skip: int = 0, limit: int = 50, most: int = 100, user_id: int | None = None) -> DataFrame:
    """A page of each user's rows (or of one user's), newest first; repeats go before rows are skipped."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("transaction_date"), F.desc("transaction_id"))
    rows = deduplicated(_of_user(tx, user_id)).withColumn("place", F.row_number().over(newest))
    return rows.where((F.col("place") > skip) & (F.col("place") <= skip + min(limit, most)))


def by_goals(tx: DataFrame, goals: DataFrame) -> DataFrame:
    """The rows of the given goals(user_id, goal_id)."""
    return tx.join(goals.select("user_id", "goal_id").distinct(), ["user_id", "goal_id"], "left_semi")


def updated_since(tx: DataFrame, cursor: int) -> DataFrame:
    """Rows at or after a cursor."""
    return tx.where(F.col("updated_at_ts") >= cursor)


def by_ids(tx: DataFrame, ids: DataFrame) -> DataFrame:
    return tx.join(ids, "transaction_id", "left_semi")


def composite_matches(tx: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the same account, amount and day whose description or merchant is the wanted description."""
    w = wanted.select(F.col("account_id").alias("w_account"), F.col("amount").alias("w_amount"), F.col("transaction_date").alias("w_date"), F.col("description").alias("w_text"), F.col("transaction_id").alias("wanted_id"))
    same = (F.col("account_id") == F.col("w_account")) & (F.col("amount") == F.col("w_amount")) & (F.col("transaction_date") == F.col("w_date"))
    return tx.join(w, same).where((F.col("description") == F.col("w_text")) | (F.col("merchant_name") == F.col("w_text"))).select("wanted_id", "transaction_id")


def search(tx: DataFrame, start: str, end: str, category: str | None = None, merchant: str | None = None) -> DataFrame:
    rows = tx.where(not_deleted() & between("transaction_date", start, end))
    if category:
        rows = rows.where(F.col("category_primary") == category)
    return rows.where(F.lower("merchant_name").contains(merchant.lower())) if merchant else rows


def append_new(rows: DataFrame, path: str, key: str = "transaction_id") -> None:
    """Append the rows whose key is not there yet."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows.dropDuplicates([key]).write.parquet(path)
        return
    rows.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(path)


def archive(tx: DataFrame, path: str, as_of: str, days: int = 365, files: int = 16) -> None:
    """Rows older than a year as compressed JSON, a folder a year of at most `files` files, each written by a task of its own."""
    old = tx.where(F.col("transaction_date") < F.date_add(day(as_of), -days))
    old.withColumn("year", F.year("transaction_date")).repartition("year", F.pmod(F.xxhash64("transaction_id"), F.lit(files))).write.partitionBy("year").option("compression", "gzip").mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV (quotes doubled inside quotes, as spreadsheets read it) or JSON."""
    if kind == "csv":
        rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def sync_status(**frames: DataFrame) -> DataFrame:
    """Rows and latest cursor of each frame."""
    parts = [f.agg(F.count("*").alias("n"), (F.max("updated_at_ts") if "updated_at_ts" in f.columns else F.lit(None)).cast("bigint").alias("cursor")).withColumn("frame", F.lit(n)) for n, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("frame", "n", "cursor")
