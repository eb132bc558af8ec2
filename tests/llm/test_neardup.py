import random
import re

import numpy as np
import pytest

from ledgerlake.llm import neardup as N
from ledgerlake.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, rep string, n string, component string"


def brute_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(docs):
    sets = {i: brute_set(t) for i, t in docs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(rng):
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            docs.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    chain = [f"c{k}" for k in range(100)]
    for k in range(25):  # neighbours are similar, far ones are not
        docs.append(" ".join(chain))
        chain = chain[2:] + [f"n{k}a", f"n{k}b"]
    rng.shuffle(docs)
    docs += ["", "  ", "one two", "ONE\ttwo", None, "Kelvin K é É one two"]
    return [(i * 3 % 1009, t) for i, t in enumerate(docs)]


def run(spark, docs):
    got = N.near_duplicates(spark.createDataFrame([(*d, "", "", "") for d in docs], SCHEMA)).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)


def test_components_equal_brute_force(spark, monkeypatch):
    docs = corpus(random.Random(7))
    assert run(spark, docs) == brute(docs)
    kept = N.deduplicate(spark.createDataFrame([(*d, "", "", "") for d in docs], SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in brute(docs) if k] and kept.columns[2:] == ["rep", "n", "component"]


def test_small_tiles_and_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 2)
    monkeypatch.setattr(N, "SLICE", 3)
    monkeypatch.setattr(N, "SET_TILE", 100)
    monkeypatch.setattr(N, "SET_SLICE", 200)
    monkeypatch.setattr(N.bounded, "__defaults__", (0,))
    docs = corpus(random.Random(8))
    assert run(spark, docs) == brute(docs)


def test_nulls_repeats_and_empty(spark):
    docs = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B C D E F G"), (None, "a b c d e f g"), (3, "x y"), (3, "p q"), (4, "p q"), (5, None)]
    got = N.near_duplicates(spark.createDataFrame([(*d, "", "", "") for d in docs], SCHEMA)).collect()
    assert sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in got)) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True)]
    left = N.deduplicate(spark.createDataFrame([(*d, "", "", "") for d in docs], SCHEMA)).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 1, 3, 5]
    assert run(spark, []) == []


def test_large_and_small_star(spark):
    rng = random.Random(1)
    pairs = [(a, a + 1) for a in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((i, find(i)) for i in root)


def test_a_pair_at_the_threshold_is_rarely_missed():
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        common = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a = np.concatenate([common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
        b = np.concatenate([common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
        left, right = N.band_keys(N.minima([a, b]))
        missed += not (left == right).any()
    assert missed == 0


def test_no_candidate_is_left_to_a_band_it_does_not_share(spark):
    rng = random.Random(5)
    docs = []
    for k in range(2500):  # pairs just above the threshold: 40 words, 3 of the 36 shingles changed at either end
        words = [f"p{k}w{i}" for i in range(40)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([f"x{rng.random()}"] * 2 + words[2:38] + [f"y{rng.random()}"] * 2))]
    keys = {i: N.band_keys(N.minima([N.shingles(t.encode())]))[0] for i, t in docs}
    wanted = {(i, i + 1) for i in range(0, len(docs), 2) if (keys[i] == keys[i + 1]).any()}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sigs = N.save(N.signatures(df), "signatures")
    nodes = N.save(sigs.groupBy("class").agg(N.F.min("doc_id").alias("rep")).withColumn("node", N.F.col("rep")), "nodes")
    reps = N.save(sigs.join(nodes, "class").select("node", "n", "bands"), "class-signatures")
    entries = reps.select(N.F.posexplode("bands").alias("band", "key"), "node", "n")
    none = spark.createDataFrame([], "node bigint, component bigint")
    rows = N._mixed(entries, none)
    both = N._long_signatures(df, nodes, rows, reps)
    # Each pair is two components: all its links come out, the others only through no candidate at all.
    sets = {i: brute_set(t) for i, t in docs}
    wanted = {(i, j) for i, j in wanted if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in N._rest(df, nodes, rows, both).collect()}
    assert len(wanted) > 2000
    assert wanted == got


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_short_texts(n):
    assert len(N.shingles(b" ".join([b"w%d" % i for i in range(n)]))) == max(min(n, 1), n - 4)


def test_shingles_of_odd_texts_equal_brute_force():
    rng = random.Random(11)
    pieces = [b"a", b"B", b"b", b" ", b" ", b"\n", b"\t", "\u00e9".encode(), b"xyz"]
    texts = [None, b"", b" \n", b"A b", b"w" * 70_000 + b" a b c d e f", b"q " * 50_000] + [b"".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(2000)]
    sets = list(N.shingle_sets(N.pa.concat_arrays([N.pa.array([b"cut off"]), N.pa.array(texts, N.pa.binary())]).slice(1)))
    by_set = {}
    for text, found in zip(texts, sets, strict=True):
        wanted = brute_set((text or b"").decode())
        assert len(found) == len(wanted)
        assert by_set.setdefault(wanted, found.tobytes()) == found.tobytes()
    assert len(set(by_set.values())) == len(by_set)


def test_texts_under_the_least_doc_id_of_both_keep_their_own_links(spark):
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    docs = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one + ["x"])), (3, " ".join(two + ["y"])), (4, " ".join(two))]
    assert {r[0]: r[2] for r in run(spark, docs)} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_a_group_beside_the_least_class_of_its_bucket(spark):
    """A line that all share makes one bucket; its least document is like none of the 300 near copies."""
    rng = random.Random(12)
    base = [f"g{i}" for i in range(200)]
    docs = [(0, " ".join(base[:5] + [f"z{i}" for i in range(200)]))]
    for k in range(1, 301):
        w = list(base)
        w[rng.randrange(5, 200)] = f"r{k}"
        docs.append((k, " ".join(w)))
    assert run(spark, docs) == brute(docs)


def test_clashing_names_and_repeated_rows(spark):
    schema = "doc_id bigint, text string, __dropped string, __again string, __r string, of string, row string, id string"
    docs = [(i, t, "d", "a", "r", "o", "w", "i") for i, t in [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "p q r s t u")]]
    kept = N.deduplicate(spark.createDataFrame(docs, schema))
    assert kept.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, kept.collect())) == [docs[0], docs[3]]


def test_very_long_text(spark):
    text = " ".join(f"l{i}" for i in range(300_000))
    assert {r[0]: (r[1], r[2]) for r in run(spark, [(1, text), (2, text + " more"), (3, "x y z")])} == {1: (299_996, 1), 2: (299_997, 1), 3: (1, 3)}
