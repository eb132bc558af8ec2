import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import mixing as M

SCHEMA = "doc_id bigint, text string, source string, size string, target string, __extra int"


def corpus():
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), ["a", "b", "ü", "z", None][min(4, rng.randrange(9))], "", "", 1) for i in range(600)]
    return [*rows, (700, None, "a", "", "", 1), (701, "", "only empty", "", "", 1), (702, "!!! ### $$$", "a", "", "", 1)]


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    got = M.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == len(corpus())
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = expected_targets(sizes)
    taken = {}
    for r in got:
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert {tuple(r) for r in M.mix_report(docs.repartition(7)).collect()} == {tuple(r)[:5] for r in M.mix_report(docs).collect()}


def test_rows_come_as_often_as_the_report_says(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in M.mix_report(docs).where("size > 0").collect():
        assert times.get(r.doc_id, 0) * r.size == r.taken


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, ("word " * 20) if i % 2 else ("w### " * 20), "s", "", "", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = M.mix_report(docs, share_percent=40).groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("t")).collect()
    t = {r.good: r.t for r in got}
    assert t[1] > 1.3 * t[0]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.mix_report(none).collect() == [] and M.mix(none).collect() == []


def test_repeated_rows_are_cut_by_copy(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(10, 60)), "s", "", "", 1) for i in range(300)] + [(900, " ".join(["v"] * 30), "s", "", "", 1)] * 1000 + [(901, "u " * 40, "t", "", "", 1)] * 500
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for percent in (20, 60, 90, 130, 150):
        got = M.mix_report(docs, share_percent=percent, weights=(1,)).collect()
        for size in {r.source_size for r in got}:
            own = [r for r in got if r.source_size == size]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and all(r.taken <= 2 * r.size for r in own)
        mixed = M.mix(docs, share_percent=percent, weights=(1,)).groupBy("doc_id").count().collect()
        assert {r.doc_id: r["count"] for r in mixed if r["count"]} == {i: n for i in {r.doc_id for r in got} if (n := sum(r.taken // r.size for r in got if r.doc_id == i))}


def test_clashing_names(spark):
    schema = "doc_id bigint, text string, source string, __key double, __size string, __again int, __cut string, __of string, row string, key string, cut int, of string, times int, part int, at int"
    rows = [(i, "w " * (i + 5), "s", 0.5, "z", 7, "c", "o", "r", "k", 1, "o", 2, 3, 4) for i in range(20)] * 2
    docs = spark.createDataFrame(rows, schema)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows) and mixed.count() > 20


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "s", "", "", 1), (2, "a b", "s", "", "", 1)], SCHEMA)
    assert {r.doc_id: (r.size, r.source_size) for r in M.mix_report(docs).collect()} == {1: (400_000, 400_002), 2: (2, 400_002)}
