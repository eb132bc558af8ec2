import os
import random

import pytest

from ledgerlake.sources import keyed
from ledgerlake.sources.keyed import KeyedTable

SCHEMA = "id bigint, ts bigint, deleted boolean, value string"


def newest(changes):
    best = {}
    for id_, ts, deleted, value in changes:
        if id_ is not None and ts is not None:
            best[id_] = max(best.get(id_, (-1, False, "")), (ts, bool(deleted), value))
    return {(i, ts, v) for i, (ts, deleted, v) in best.items() if not deleted}


@pytest.mark.parametrize("n_batches", [1, 3, 7])
def test_any_batching_and_order_gives_one_table(spark, tmp_path, n_batches):
    changes = [(i, ts, rng.random() < 0.3, f"{i}-{ts}") for rng in [random.Random(1)] for _ in range(300) for i, ts in [(rng.randrange(40), rng.randrange(30))]]
    rng = random.Random(n_batches)
    mixed = [*changes, *rng.sample(changes, 40), (None, 5, False, "no key"), (5, None, False, "no time")]
    rng.shuffle(mixed)
    table = KeyedTable(spark, str(tmp_path / "t"), "id", "ts", buckets=5)
    for k in range(n_batches):
        table.merge(spark.createDataFrame(mixed[k::n_batches], SCHEMA))
    assert {tuple(r) for r in table.read().select("id", "ts", "value").collect()} == newest(mixed)
    assert len(table.versions()) <= keyed.KEPT
    kept = {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "t" / "data") for f in fs if f.endswith(".parquet")}
    assert len(kept) <= 5 * keyed.KEPT * 4


def test_late_rows_updates_and_deletions(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", "ts", buckets=3)
    with pytest.raises(ValueError, match="no version"):
        table.read()
    rows = lambda *r: spark.createDataFrame(r, SCHEMA)
    got = lambda: {r.id: r.value for r in table.read().collect()}
    table.merge(rows((1, 5, None, "five"), (2, 5, None, "two")))
    table.merge(rows((1, 3, None, "three")))
    assert got() == {1: "five", 2: "two"}
    table.delete(rows((2, 6, None, None)))
    table.merge(rows((2, 4, None, "late")))
    assert got() == {1: "five"}
    version = table.merge(rows((2, 7, None, "again"), (1, 5, None, "five")))
    assert got() == {1: "five", 2: "again"} and table.merge(rows()) == version
    table.delete(rows((1, 8, None, None)))
    table.merge(rows((1, 1, None, "old"), (2, 1, None, "old"), (3, 9, None, "new")), forget_before=9)
    assert table.read(with_deleted=True).where("deleted").collect() == [] and got() == {2: "again", 3: "new"}


def test_a_merge_that_was_lost_leaves_no_trace(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", "ts", buckets=2)
    table.merge(spark.createDataFrame([(1, 1, False, "a")], SCHEMA))
    spark.createDataFrame([(1, 9, False, "lost", 0)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "t" / "data" / "v=2"))
    os.makedirs(tmp_path / "t" / "manifests" / "2")
    assert [r.value for r in table.read().collect()] == ["a"]
    assert table.merge(spark.createDataFrame([(2, 1, False, "b", 7)], SCHEMA + ", more int")) == 3
    assert {(r.value, r.more) for r in table.read().collect()} == {("a", None), ("b", 7)}
    assert not os.path.exists(tmp_path / "t" / "data" / "v=2")


def test_pending_rows_give_way_and_hand_on_what_the_user_set(spark):
    rows = spark.createDataFrame([("p1", True, None, "mine"), ("t1", False, "p1", None), ("p2", True, None, "x"), ("t3", False, "gone", None), ("t4", None, "p1", "own"), ("t5", True, "p2", None)], "transaction_id string, pending boolean, pending_transaction_id string, note string")
    got = {r.transaction_id: r.note for r in keyed.settled(rows, own=("note",)).collect()}
    assert got == {"t1": "mine", "t3": None, "t4": "own", "p2": "x", "t5": None}


def test_rows_of_a_feed_are_taken_for_rows_without_feed_id(spark):
    base = (1, 2, 3, "2024-01-01")
    rows = [("m1", *base, "a", None), ("m2", *base, "a", ""), ("f1", *base, "a", "x"), ("f2", *base, "b", "y"), ("n", 1, None, 3, "2024-01-01", "a", None), ("f3", 1, None, 3, "2024-01-01", "a", "z")]
    df = spark.createDataFrame(rows, "transaction_id string, user_id int, account_id int, amount int, transaction_date string, description string, plaid_transaction_id string")
    got = {r.transaction_id: r.plaid_transaction_id for r in keyed.adopted(df).collect()}
    assert got == {"m1": "x", "m2": "", "f2": "y", "n": None, "f3": "z"}


def test_an_archive_has_several_files_a_year(spark, tmp_path):
    import datetime as dt

    from ledgerlake.sources import tables

    tx = spark.createDataFrame([(str(i), dt.date(2020 + i % 2, 1, 5)) for i in range(200)] + [("new", dt.date(2023, 12, 1))], "transaction_id string, transaction_date date")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged
    try:
        tables.archive(tx, str(tmp_path / "a"), "2024-01-01", files=4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    written = [f for d, _, fs in os.walk(tmp_path / "a") for f in fs if f.endswith(".json.gz")]
    assert spark.read.json(str(tmp_path / "a")).count() == 200 and 2 < len(written) <= 8


def test_rows_without_a_link_are_dealt_over_all_tasks(spark):
    """Rows that name no pending row stay in the tasks of their own ids; under one null key they would meet in a single task."""
    rows = spark.range(2000).selectExpr("CAST(id AS STRING) AS transaction_id", "id % 10 = 0 AS pending", "IF(id % 10 = 1, CAST(id - 1 AS STRING), NULL) AS pending_transaction_id", "IF(id % 10 = 0, 'kept', NULL) AS note")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        parts = [p for p in keyed.settled(rows, own=("note",)).rdd.glom().collect() if p]
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert sum(map(len, parts)) == 1800 and max(map(len, parts)) < 900
    assert sorted(int(r.transaction_id) for p in parts for r in p if r.note) == list(range(1, 2000, 10))
