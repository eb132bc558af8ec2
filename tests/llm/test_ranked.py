import math
import random
import re
from collections import Counter

import pytest

from ledgerlake.llm import ranked


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def expected(docs, items, k=20):
    listed = [(d, terms(t)) for d, t in docs]
    listed = [(d, Counter(w), len(w)) for d, w in listed if w]
    n_docs, n_terms = len(listed), sum(n for *_, n in listed)
    df = Counter(t for _, c, _ in listed for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, tf, n in listed:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -score) for i, (score, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def some(rng, n=300):
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 400}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 30, 200])))) for i in range(n)]
    docs += [(i, "The SAME copy, again: w1 w2") for i in range(n, n + n // 2)]  # a third of all rows, all ties
    docs += [(3, docs[3][1]), (None, docs[4][1]), (n * 2, None), (n * 2 + 1, ""), (n * 2 + 2, "?! --"), (n * 2 + 3, "Éclair ÉCLAIR é")]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 20])))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "nowhere"), (43, "the same copy same"), (44, "éclair É"), (1, "w7 w8"), (1, "w7 w8")]
    return docs, items


@pytest.mark.parametrize(("block", "slice_bytes", "vocabulary"), [(1 << 18, 4_000_000, 16_000_000), (300, 200, 16_000_000), (500, 400, 0)])
def test_search_against_brute_force(spark, block, slice_bytes, vocabulary, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_WORDS", block)
    docs, items = some(random.Random(block))
    a = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score long, rank int").repartition(3)
    b = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")
    got = ranked.search(a, b, slice_bytes=slice_bytes, vocabulary_bytes=vocabulary)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items)
    assert ranked.search(a.limit(0), b).collect() == [] and ranked.search(a, b.limit(0)).collect() == []


def test_bounds_leave_frequent_terms_out():
    known = {b"rare": (9000, 800_000, 700_000), b"often": (40, 500_000, 500_000), b"never": (0, 9, 9)}
    query = ranked.Query(Counter({b"often": 3, b"rare": 1, b"never": 1, b"absent": 2}), known)
    assert [t for t, _ in query.terms] == [b"rare", b"often"] and query.seed == 9000 * 700_000
    assert query.bounds == [9000 * 800_000 + 3 * 40 * 500_000, 3 * 40 * 500_000, 0]
    assert sum(b >= query.seed for b in query.bounds[:-1]) == 1


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "needle " + "hay " * 600_000), (2, "needle"), (3, "hay"), (4, "straw")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "needle")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in ranked.search(docs, items).orderBy("rank").collect()] == [(1, 2), (2, 1)]
