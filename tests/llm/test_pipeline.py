import hashlib
import math
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_decontaminate
import test_neardup
import test_quality
import test_tokenfile


def take(docs, rates=(5, 2, 1)):
    """docs: (doc_id, text, source) -> (doc_id, text) as often as the mix takes them; iterated resharing, one source sorted at a time."""
    size = {d: len(test_quality.WORD.findall(t)) for d, t, _ in docs}
    sources = sorted({s for *_, s in docs})
    of = {s: sum(size[d] for d, _, x in docs if x == s) for s in sources}
    weight = {s: rates[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        rest = 1.5 * sum(of.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * of[s]}
        if not over:
            break
        target |= {s: 2.0 * of[s] for s in over}
        open_ -= over
    target |= share
    out = []
    for s in sources:
        keyed = []
        for d, t, x in docs:
            if x == s:
                u = (int(hashlib.md5(f"mix-1|{d}|{t}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                q = max(0.05, sum(c not in "#*$%&|<>" for c in t) / len(t))
                keyed.append((-math.log(u) / q, d, t))
        epochs, before = math.floor(target[s] / of[s] + 1e-12), 0
        rest = target[s] - epochs * of[s]
        for _, d, t in sorted(keyed):
            out += [(d, t)] * (epochs + (2 * before + size[d] <= 2 * rest))
            before += size[d]
    return out


@pytest.fixture
def tables(tmp_path):
    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("no test data")
    docs = pd.read_parquet(f"{source}/documents.parquet")
    return source, docs, pd.read_parquet(f"{source}/benchmark.parquet")


def test_run_equals_brute_force(spark, tables):
    import corpus_pipeline

    source, docs, benchmark = tables
    rows = [(d, t, s) for d, t, s in zip(docs.doc_id, docs.text, docs.source, strict=True)]

    def good(t):
        n, chars, symbols, dup, rep = test_quality.brute(t)
        lines = [x for x in t.split("\n") if test_quality.WORD.search(x)]
        return n >= 50 and 100 * rep <= 50 * n and 10 * symbols <= 3 * n and 2 * dup <= len(lines)

    rows = [r for r in rows if good(r[1])]
    keep = {i for i, _, _, kept in test_neardup.brute([(d, t) for d, t, _ in rows]) if kept}
    rows = [r for r in rows if r[0] in keep]
    items = list(zip(benchmark.item_id, benchmark.text, strict=True))
    rows = [r for r in rows if not ((b := test_decontaminate.brute(r[1], items))[1] > 0 and 20 * b[1] >= b[0])]
    expected = test_tokenfile.expected(sorted(take(rows), key=lambda r: (r[0], r[1].encode())))
    got = corpus_pipeline.run(spark, source).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected and len(expected) > 50


def test_stages_keep_columns_and_take_nulls(spark, tables):
    import corpus_pipeline

    source, *_ = tables
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, failures string, __extra int"
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en", "s", 1, "f", 2), (2, text, None, None, None, None, None), (None, None, None, None, None, None, None), (3, text[::-1], "en", None, 1, "f", 2)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, source)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), source).collect() == []


def test_a_run_leaves_its_result_only(spark, tmp_path, monkeypatch):
    import os

    import corpus_pipeline
    from ledgerlake.llm import common

    rows = [(i, " ".join(f"w{(i * 7 + k) % 400}" for k in range(80)), "en", "s", 1) for i in range(12)] + [(20, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = tmp_path / "shared"
    monkeypatch.setattr(common, "shared_dir", lambda session: f"file://{shared}")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    assert [d.split("-")[:3] for d in sorted(os.listdir(shared))] == [["stage", "token", "files"]]
