import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"


def expected(rows, longest_free=40, least=5):
    """The contract by plain loops: kept texts by row."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    ids = lambda d: -(1 << 63) if d is None else d
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(ids(d))
    gone = {k: max(v) for k, v in holders.items() if len(k) >= longest_free and len(v) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), ids(d)) == ids(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def some_rows(rng, n=120):
    pool = [f"{'Common line of text ' * 3}{i}" for i in range(6)] + ["é" * 39, "é" * 40, "x" * 39, "x" * 40, " " + "y" * 40, "", "  ", "short"]
    rows = []
    for i in range(n):
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", " \x0b"]) for x in rng.choices(pool, k=rng.randint(0, 6))]
        rows.append((i, "\n".join([*lines, f"a line of its own that is long enough to count {i}"])))
    hot = "a third of all rows hold this very common line of text, whatever else"
    rows += [(1000 + i, f"{hot}\nown {i}") for i in range(n // 2)]
    return rows + [(3, None), (4, ""), (None, pool[0]), (None, pool[1] + "\n" + pool[0]), (7, rows[7][1]), (7, rows[7][1]), (7, "another text of 7\n" + pool[2])]


@pytest.mark.parametrize("partitions", ["4", "150"])
def test_query_against_brute_force(spark, tmp_path, partitions):
    rows = some_rows(random.Random(5))
    schema = "doc_id long, text string, n_lines string, keep string"
    spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, linededup.op12_line_dedup(spark, str(tmp_path)).collect()), key=str)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == sorted(((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in expected(rows)), key=str)


def test_apply_keeps_columns_and_rows(spark):
    rows = some_rows(random.Random(6))
    docs = spark.createDataFrame([(d, t, "row", "raw", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row string, raw string, mark int")
    out = linededup.deduplicate(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    want = {i: (t if n else rows[i][1]) for i, (d, _, n, t) in enumerate(expected(rows))}
    assert {r.mark: r.text for r in out.collect()} == want
    assert linededup.deduplicate(docs.limit(0)).collect() == []


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 1000])
def test_pieces_and_summaries_decide_as_one_stream(cut, monkeypatch):
    """Sorted entries cut anywhere into partitions, with little room for waiting entries."""
    monkeypatch.setattr(linededup, "WAITING", 2)
    rng = random.Random(cut)
    found = sorted({(bytes([rng.randrange(5)]) * 16, rng.randrange(12), rng.randrange(3)) for _ in range(90)}, key=lambda e: (e[0], -e[1], e[2]))
    names = ["key", "doc", "mark", "n_lines", "lines"]
    told = []
    for a in range(0, len(found), cut):
        part = [dict(zip(names, (*e, 1, b"\0\0\0\0"), strict=True)) for e in found[a : a + cut]]
        told += [r for b in linededup.stream(iter([pa.RecordBatch.from_pylist(part)])) for r in b.to_pylist()]
    docs = {}
    for key, doc, _ in found:
        docs.setdefault(key, set()).add(doc)
    decided = {(r["key"], r["doc"], r["mark"]) for r in told if r["state"] == 0}
    for r in told:
        if r["state"] == 1:
            pieces = sorted(((p["doc"], p["last"], p["n_docs"]) for p in told if p["state"] == 2 and p["key"] == r["key"]), reverse=True)
            total = sum(p[2] for p in pieces) - sum(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
            assert total == len(docs[r["key"]])
            if total >= 5 and r["doc"] != pieces[0][0]:
                decided.add((r["key"], r["doc"], r["mark"]))
    assert decided == {e for e in found if len(docs[e[0]]) >= 5 and e[1] != max(docs[e[0]])}


def test_hot_line_spreads_and_only_bitmaps_leave(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same boilerplate in every one of the documents of this test\n"), "id").alias("text"))
    bitmaps = linededup.keep_bitmaps(docs)
    assert bitmaps.columns == ["doc", "mark", "n_lines", "n_dropped", "keep"]
    got = bitmaps.agg(F.count("*"), F.min("doc"), F.max("doc"), F.max(F.length("keep")), F.sum("n_dropped")).first()
    assert tuple(got)[:3] == (2999, 0, 2998) and got[3] < 20 and got[4] == 2999


def test_very_long_text(spark):
    lines = [f"line number {i % 50_000} of a very long text, with more than forty letters" for i in range(100_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines if i == 9 else lines[:1])) for i in range(3, 10)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in linededup.deduplicate(docs).collect()}
    assert out[9] == "\n".join(lines) and all(out[i] == "" for i in range(3, 9))
