import hashlib
import random
import re

import pytest

from ledgerlake.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id bigint, text string, term string, n_hit string"
ITEMS = "item_id bigint, text string, doc_id string"


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, ids = split(text), set(), set()
    for item, t in items:
        b = split(t)
        for i in range(max(1, len(b) - 12) if b else 0):
            win = b[i : i + 13]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add("" if item is None else str(item))
    return len(w), len(hit), sorted(ids)


def data():
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "Évi", "x1", "rare", "word", "ß", "é", "and"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 13, 15, 30])))) for i in range(8)]
    items += [(100, None), (101, " !! "), (0, items[0][1]), (None, "only this one")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40]))) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, rng.choice(items)[1] or "")
        docs.append((i, "-".join(parts).upper() if i % 2 else ", ".join(parts)))
    docs += [(None, items[0][1]), (7, items[1][1]), (7, items[1][1]), (200, None), (201, ""), (202, "Only THIS one"), (203, ("the of " * 20000) + items[3][1])]
    return docs, items


@pytest.mark.parametrize("slices", [{}, {"slice_bytes": 160}, {"slice_bytes": 160, "vocabulary_bytes": 0}])
def test_hits_equal_brute_force(spark, slices, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 500)
    docs, items = data()
    frame = spark.createDataFrame([(*d, "", "") for d in docs], DOCS)
    bench = spark.createDataFrame([(*i, "") for i in items], ITEMS)
    got = sorted(((r.doc_id or -1, r.n_words, r.n_hit, list(r["items"])) for r in D.hits(frame, bench, **slices).collect()), key=repr)
    assert got == sorted(((i or -1 if i != 0 else -1, *brute(t, items)) for i, t in docs), key=repr)
    left = D.decontaminate(frame, bench)
    assert left.columns == frame.columns
    clean = sorted(i or -1 for i, t in docs if not ((b := brute(t, items))[1] > 0 and 20 * b[1] >= b[0]))
    assert sorted(r.doc_id or -1 for r in left.collect()) == clean


def test_empty_tables(spark):
    docs, items = data()
    frame, bench = spark.createDataFrame([(*d, "", "") for d in docs], DOCS), spark.createDataFrame([(*i, "") for i in items], ITEMS)
    assert D.hits(frame.limit(0), bench).collect() == []
    assert {r.n_hit for r in D.hits(frame, bench.limit(0)).collect()} == {0}
    assert hashlib.sha256(b"").hexdigest()


def test_phrase_and_proximity_over_a_full_index(spark):
    docs = spark.createDataFrame([(1, "a quick brown fox, the quick fox"), (2, "fox quick"), (3, "brown quick x x x x fox")], "doc_id bigint, text string")
    index = D.build_index(docs)
    exact = D.phrase_matches(index, {"p": "Quick brown", "q": "quick fox", "none": "zebra"}).collect()
    assert sorted((r.name, r.doc_id, r.position) for r in exact) == [("p", 1, 1), ("q", 1, 5)]
    near = D.phrase_matches(index, {"n": "quick fox"}, slop=2).collect()
    assert {r.doc_id for r in near} == {1, 2}


def test_a_block_visits_only_windows_whose_rarest_term_it_holds():
    phrases = {(b"the", b"rare"): ["1"], (b"the", b"of"): ["2"], (b"the", b"gone"): ["3"], (b"of", b"scarce", b"of"): ["4"]}
    plan = D.plan_of(phrases, {b"the": 90, b"of": 80, b"rare": 2, b"scarce": 3})
    block = type("B", (), {"packed": {b"the": b"", b"of": b"", b"scarce": b""}})
    assert sorted(i for _, _, (i,) in D.of_block(plan, block)) == ["2", "4"]
    assert [t for t, _ in next(x for x, n, _ in D.of_block(plan, block) if n == 3)] == [b"scarce", b"of", b"of"]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, "r", 3), (2, "x y z", 1, 2, "r", 3)], "doc_id bigint, text string, __bad int, __mark int, row string, bad int")
    left = D.decontaminate(docs, spark.createDataFrame([("i", "a b c")], "item_id string, text string"))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "x y z", 1, 2, "r", 3)]
