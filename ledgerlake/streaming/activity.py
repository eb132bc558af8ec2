"""The event stream (rows T01 to T07, T13, D09): each batch form has a streaming twin, equal to it once all data has come.

Lateness is not defined by the source system; the streaming forms wait WATERMARK for late rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "1 hour"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, files_at_once: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def with_watermark(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", WATERMARK) if events.isStreaming else events


def window_counts(events: DataFrame, width: str = "1 hour", kind: str | None = None) -> DataFrame:
    """Events a user and window; tumbling."""
    rows = events.where(F.col("event_type") == kind) if kind else events
    g = with_watermark(rows).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("w.start").alias("begins"), "n", F.round("total", 4).alias("total"))


def blocked_sources(events: DataFrame, width: str = "1 minute", most: int = 3) -> DataFrame:
    """Windows in which a user makes more errors than allowed."""
    return window_counts(events, width, "error").where(F.col("n") > most).select("user_id", "begins", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = with_watermark(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once; a stream remembers keys for a day."""
    if events.isStreaming:
        return events.withWatermark("ts", "24 hours").dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


#: Parts of resources and whole actions with their sensitivity, and what each factor weighs (in tenths; location and
#: device are always 0).
RESOURCES = [(80, ("/admin", "/compliance", "/audit")), (50, ("/api/transactions", "/api/accounts", "/api/budgets"))]
ACTIONS = [(70, ("DELETE", "UPDATE")), (40, ("CREATE",))]
FACTOR_TENTHS = {"pattern": 15, "resource": 13, "action": 12, "time": 10, "location": 10, "frequency": 8, "device": 7}


def behaviour_risk(activities: DataFrame, as_of: Column) -> DataFrame:
    """activities(event_id, user_id, ts, kind, resource, action) -> event_id, user_id, risk and level of those in the hour before as_of.

    A user's profile is everything until as_of: shares of kinds, resources, actions and of the present hour of day, and the mean of
    activities an hour of the profile's whole hours. The risk is the weighted mean of seven factors from 0 to 100.
    """
    known = activities.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") <= as_of)
    recent = F.col("ts") > as_of - F.expr("INTERVAL 1 HOUR")
    profile = known.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(recent).alias("n_recent"), F.count_if(F.hour("ts") == F.hour(as_of)).alias("n_hour"), F.floor((F.unix_micros(as_of) - F.unix_micros(F.min("ts"))) / 3_600_000_000).alias("age"))
    j = known.where(recent).join(profile, "user_id")
    for name in ("kind", "resource", "action"):
        shares = known.groupBy("user_id", F.col(name).alias("value")).agg(F.count("*").alias(f"n_{name}"))
        j = j.join(shares.withColumnRenamed("user_id", "of"), (F.col("user_id") == F.col("of")) & F.col(name).eqNullSafe(F.col("value")), "left").drop("of", "value")
    rare = lambda name: 10 * F.col(f"n_{name}") < F.col("n")
    at = F.col("n_recent") * F.col("age")  # against multiples of the mean, n / age
    sensitive = F.when(F.coalesce("resource", F.lit("")) == "", 0)
    for score, parts in RESOURCES:
        sensitive = sensitive.when(F.col("resource").rlike("|".join(parts)), score)
    acting = F.when(F.coalesce("action", F.lit("")) == "", 0)
    for score, names in ACTIONS:
        acting = acting.when(F.upper("action").isin(*names), score)
    factors = {
        "pattern": F.when(rare("kind"), 50).when(rare("resource"), 40).when(rare("action"), 30).otherwise(0),
        "resource": sensitive.otherwise(20),
        "action": acting.otherwise(10),
        "time": F.when(10 * F.col("n_hour") < F.col("n"), 60).when(10 * F.col("n_hour") < 3 * F.col("n"), 30).otherwise(0),
        "frequency": F.when((F.col("age") <= 0) | (at > 3 * F.col("n")), 70).when(at > 2 * F.col("n"), 40).when(10 * at < 3 * F.col("n"), 20).otherwise(0),
    }
    total = sum((FACTOR_TENTHS[name] * value for name, value in factors.items()), F.lit(0))
    risk = F.round(total / F.lit(float(sum(FACTOR_TENTHS.values()))), 4)
    return j.select("event_id", "user_id", risk.alias("risk")).withColumn("level", F.when(F.col("risk") >= 70, "HIGH").when(F.col("risk") >= 40, "MEDIUM").otherwise("LOW"))


def token_bucket(events: DataFrame, capacity: int = 5, per_second: float = 1 / 3600) -> DataFrame:
    """Which events a bucket of `capacity` tokens a user, refilled evenly, lets through. In time order within a user.

    Batch: a user's events are folded in order inside a sorted stream of rows, so no user has to fit in memory.
    """
    rows = events.select("user_id", "event_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, tokens, last = None, 0.0, None
        for pdf in batches:
            allowed = []
            for u, t in zip(pdf.user_id, pdf.ts, strict=True):
                if user is None or u != user:
                    user, tokens, last = u, float(capacity), t
                tokens = min(float(capacity), tokens + (t - last).total_seconds() * per_second)
                last = t
                allowed.append(tokens >= 1)
                tokens -= allowed[-1]
            yield pd.DataFrame({"user_id": pdf.user_id, "event_id": pdf.event_id, "allowed": allowed})

    return rows.mapInPandas(fold, "user_id bigint, event_id bigint, allowed boolean")


def token_bucket_stream(events: DataFrame, capacity: int = 5, per_second: float = 1 / 3600) -> DataFrame:
    """The same with state for each user between micro-batches; events of a micro-batch are taken in time order."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        tokens, last = state.get if state.exists else (float(capacity), None)
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for t in pdf.ts:
            seconds = t.timestamp()
            tokens = min(float(capacity), tokens + (0 if last is None else max(0.0, seconds - last)) * per_second)
            last = seconds
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        state.update((tokens, last))
        yield pd.DataFrame({"user_id": pdf.user_id, "event_id": pdf.event_id, "allowed": allowed})

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(events: DataFrame, table: str, checkpoint: str, key: str = "event_id", time: str = "ts", buckets: int = 64):
    """Each micro-batch is merged into a sources.keyed.KeyedTable: the newest row of a key by event time counts, whatever order rows come in."""
    from ledgerlake.sources.keyed import KeyedTable

    def merge(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, table, key, time, buckets=buckets).merge(batch)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def format_drift(fingerprints: DataFrame) -> DataFrame:
    """Rows whose format differs from the one before of the same source."""
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("seen_at", "doc_id")
    return fingerprints.withColumn("before", F.lag("fingerprint").over(order)).where(F.col("before").isNotNull() & (F.col("before") != F.col("fingerprint"))).select("source", "doc_id", "before", "fingerprint")
