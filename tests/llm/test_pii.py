import hashlib
import re

from ledgerlake.llm import pii

SCHEMA = "doc_id bigint, text string, row bigint, mentions string, spans string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd = [int(c) for c in d[::-1]]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10 == 0


def brute(text):
    found = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 12 <= len(d) <= 19 and luhn(d))
                or (kind == "phone" and 9 <= len(d) <= 15)
            ):
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


TEXTS = [
    None,
    "",
    "é mail a.b+c@x-y.example.com, a@b a@b@c.de_f@g.hi @x.y z@",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 ü 9.9.9.9",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 378282246310005 1 2",
    "call +1 (415) 555-2671 or +49 30 1234567 8 9 or +12 or ++1-2-3-4-5-6-7-8-9",
    "1" * 5000 + "." * 3000 + "a@" * 500,
    "x@y.z" * 300,
]


def test_base_spans_match_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t, 0, "", "") for i, t in enumerate(TEXTS)], SCHEMA)
    got = pii.identifiers(docs, support=1000)
    from pyspark.sql import functions as F

    rows = got.select("doc_id", pii.joined(F.col("spans"), pii.BASE_KINDS).alias("s")).collect()
    assert {r.doc_id: r.s for r in rows} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_patterns_learned_from_seeds_discover_unseen_identifiers(spark):
    seeds = [(i, f"please write to {w}{i}@mail.example.com today", 0, "", "") for i, w in enumerate(["ann", "bob", "cy", "di", "ed"])]
    others = [(10, "please write to ann(at)mail 55123499x today", 0, "", ""), (11, "please write to 770123456_id today", 0, "", ""), (12, "order number 991234567 arrived", 0, "", "")]
    docs = spark.createDataFrame([*seeds, *others, (13, None, 0, "", "")], SCHEMA)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.identifiers(docs).collect()}
    assert got[11] == [("found_email", 16, 28)] and got[12] == [] and got[13] == []
    assert got[0] == [("email", 16, 37)]


def test_empty_table(spark):
    assert pii.identifiers(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hashlib.sha256(b"").hexdigest()


def second_order():
    """20 seeds and 4 others share a context; the 4 and one more share another; a decoy fails its check in the first."""
    docs = [(i, f"my number is +1 415 555 {1000 + i} ok", 0, "", "") for i in range(20)]
    docs += [(30 + i, f"my number is 0{i}9 55 12{i} 77 ok", 0, "", "") for i in range(4)]
    docs += [(40 + i, f"ring then 0{i}9 55 12{i} 77 please", 0, "", "") for i in range(4)]
    docs += [(50, "ring then 088 12 345 67 please", 0, "", ""), (51, "order no 088 12 345 68 came", 0, "", ""), (52, "my number is +1 2 3 ok", 0, "", "")]
    return docs


def test_discovered_instances_support_new_patterns(spark):
    docs = spark.createDataFrame(second_order(), SCHEMA)
    for rounds, last in ((1, []), (5, ["found_phone"])):
        got = {r.doc_id: [s.kind for s in r.spans] for r in pii.identifiers(docs, rounds=rounds).collect()}
        assert all(got[30 + i] == ["found_phone"] for i in range(4))
        assert got[50] == last and got[51] == got[52] == []


def test_scores_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    words = ["my", "no", "call", "is", "at", "the"]
    texts = [" ".join(rng.choice(words) for _ in range(3)) + " " + rng.choice(["a%d@x.org" % rng.randrange(30), "+1 555 123 %04d" % rng.randrange(40), "id%07d" % rng.randrange(60), "4111 1111 1111 1112"]) + " " + " ".join(rng.choice(words) for _ in range(2)) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, 0, "", "") for i, t in enumerate(texts)], SCHEMA)
    scanned = pii.scan(docs)
    edges, seed, barred = {}, {}, set()
    for r in scanned.collect():
        for m in r.mentions:
            for p in m.patterns:
                edges.setdefault(p, set()).add(m.value)
            if m.kind:
                seed[m.value] = min(m.kind, seed.get(m.value, m.kind))
            if m.barred:
                barred.add(m.value)
    score = {v: (k, 1.0) for v, k in seed.items()}
    for _ in range(3):
        acting = {}
        for p, values in edges.items():
            mass = {}
            for v in values:
                if v in score:
                    mass[score[v][0]] = mass.get(score[v][0], 0) + score[v][1]
            rated = sorted((-m / len(values), k) for k, m in mass.items() if m >= 2 and m / len(values) >= 0.3)
            if rated:
                acting[p] = (rated[0][1], -rated[0][0])
        score = {v: (k, 1.0) for v, k in seed.items()}
        for p, (k, c) in acting.items():
            for v in edges[p] - set(seed) - barred:
                if v not in score or (0.95 * c, k) > (score[v][1], score[v][0]):
                    score[v] = (k, 0.95 * c)
    got = {r.pattern: (r.kind, r.confidence) for r in pii.confident_patterns(scanned, rounds=3, confidence=0.3, support=2).collect()}
    assert {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in acting.items()} and len(got) > 20
    assert all(abs(got[p][1] - c) < 1e-9 for p, (_, c) in acting.items())
    assert barred and any(v not in seed for v in score)


def test_mentions_of_many_forms():
    def found(text):
        raw = text.encode()
        return [raw[a:b].decode() for a, b in pii.other_identifiers(raw, pii.base_spans(raw))]

    assert found("ssn 078-05-1120, plate AB 123 456 and GB29NWBK60161331926819.") == ["078-05-1120", "123 456", "GB29NWBK60161331926819"]
    assert found("x (at) y dot com, x(at)y.com or ann [at] mail [dot] example.org") == ["x(at)y.com", "ann [at] mail [dot] example.org"]
    assert found("(030) 123 45 67 12.5kg only 12345 " + "9" * 500) == ["(030) 123 45 67"]
    assert found("user@host and 1.2.3.4") == ["user@host"]
    assert pii.is_barred(b"4111 1111 1111 1112") and pii.is_barred(b"1.2.3.400") and not pii.is_barred(b"078-05-1120")
