import hashlib
import random
import zlib

import pytest

from ledgerlake.llm import periodic


def all_runs(w, min_length=24, min_exponent=3):
    """Every maximal stretch of every period, smallest period of a stretch only."""
    found, n = {}, len(w)
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((b, e, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_of_random_sequences(exponent):
    rng = random.Random(exponent)
    for _ in range(1500):
        n, letters, least = rng.randint(0, 70), rng.randint(1, 4), rng.randint(2, 9)
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):  # periodic parts and copies of parts
            if n > 4:
                a, q, m = rng.randrange(n), rng.randint(1, 6), rng.randint(4, 40)
                w[a : a + m] = [w[a + i % q] if a + i % q < len(w) else 0 for i in range(min(m, n - a))]
                a, b, m = rng.randrange(n), rng.randrange(n), rng.randint(2, 40)
                part = w[a : a + m]
                w[b : b + len(part)] = part[: n - b]
        w = w[:n]
        assert periodic.runs_of_ids(w, least, exponent) == all_runs(w, least, exponent), (w, least)
        assert periodic.runs_of([b"%d" % x for x in w], least, exponent) == all_runs(w, least, exponent), (w, least)


def test_factors_are_longest_and_earlier():
    rng = random.Random(9)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        at = 0
        for start, end, source in periodic.factors(w):
            assert start == at
            at = end
            longest = max((m for s in range(start) for m in range(len(w) - start + 1) if w[s : s + m] == w[start : start + m]), default=0)
            assert end - start == max(1, longest)
            assert source == start or (source < start and all(w[source + i] == w[start + i] for i in range(end - start)))
        assert at == len(w)


def expected(doc_id, text):
    w = (text or "").encode().split()
    w = periodic._planted_words(doc_id, (text or "").encode()) if w else w
    found = all_runs(w)
    top = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    gone = {i for b, e, q in found for i in range(b + q, e)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, digest("".join(f"{b},{e - b},{q}\n" for b, e, q in found).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    planted = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = {i: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 5, 40, 200, 700]))) for i in planted[:30]}
    texts |= {1: None, 2: "", 3: " \n\t ", 5: "ha " * 23, 6: "ha\n" * 24, 7: "ab  cd\tef " * 8 + "gh", 8: ("a b c d " * 7 + "x y z ") * 4, 9: "é ß " * 30, 11: "the cat sat " * 9 + "on " * 40}
    rows = [(i, t, "extra") for i, t in texts.items()] + [(6, texts[6], "again"), (None, "x " * 50, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=str)


def test_very_long_text_and_collapse(spark):
    long = " ".join(f"w{i % 1000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long, 7), (2, "one two", 8), (3, None, 9)], "doc_id long, text string, n_words long")
    assert [r.runs for r in periodic.runs(docs).orderBy("doc_id").collect()] == [[(0, 200_000, 1000)], [], []]
    out = periodic.collapse(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, " ".join(f"w{i}" for i in range(1000)), 7), (2, "one two", 8), (3, None, 9)]
    assert periodic.runs(docs.limit(0)).collect() == []
