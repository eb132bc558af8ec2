"""Operator 6, PII by bootstrapped contextual extraction.

One pass over the whole texts finds the seed entities (the base kinds of the contract) and every other identifier-like mention: a
token, or up to GROUPS digit groups in a row, with LEAST_DIGITS digits or more; a token with an @; an address written with (at).
Each has its lexical patterns: the two words before it, the two words after it, the word on either side, and the word before with
the mention's shape (letters and digits by their runs). Words in patterns are lower-cased, their digits are all one, their
punctuation is off. Patterns and instances (hashed values) form a bipartite graph, which Spark scores in rounds: a pattern's mass
for a kind is the sum of its instances' scores, its confidence that sum over their number. A pattern acts from CONFIDENCE and from a
mass of SUPPORT on. An instance that acting patterns mark has the best one's confidence times DECAY as its score, and supports
further patterns in the next round; DECAY bounds the drift. In the end acting patterns mark their unseen mentions, as kind
`found_KIND`.

A mention that a base kind's form matches but its check refuses (a card number that fails Luhn, an address part over 255, a phone
number with too few or too many digits) is barred: it counts against its patterns and is never marked.

Defined results: a null or empty text has no spans; an instance or pattern counts once however many rows repeat it, so hot
values and word pairs are combined before the shuffle; ties between kinds go to the first by name; an empty table gives no
rows. Mentions over LONGEST bytes that are no seeds are none; very long texts are scanned whole, one at a time. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded, map_batches, save, scratch, table, utf8
from ledgerlake.llm.spans import count_kind, in_code_points, joined, value_hash

#: The base kinds, in the order of the contract.
BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can only begin where a run of digits does
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")
_BLANK = frozenset(b" \t\n\r\x0b\x0c")

LEAST_DIGITS, GROUPS, LONGEST = 6, 6, 64
ROUNDS = 5
CONFIDENCE, SUPPORT, DECAY = 0.6, 3, 0.95

_HIT = re.compile(rb"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
_AT = re.compile(rb"[A-Za-z0-9._%+-]+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]+(?:(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
_GROUP = re.compile(rb"\x20\(?[0-9][0-9().-]*+(?![^\x20\t\r\n\x0b\x0c.,;:!?)])")
_EDGE = b"\"'`.,;:!?()[]{}<>*#$%&|"
_MARKS = bytes(range(33, 48)) + b":;<=>?@[]^`{|}~"
_DIGITS_AS_ONE = bytes(48 if 48 <= c <= 57 else c for c in range(256))
_SHAPE = bytes(57 if 48 <= c <= 57 else 97 if 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else c for c in range(256))


def _emails(raw: bytes) -> list[tuple[int, int]]:
    """An address can only lie around an @: the run of local characters before it, a domain after it."""
    out, last, at = [], 0, raw.find(b"@")
    while at >= 0:
        begin = at
        while begin > last and raw[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(raw, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            last = m.end()
        at = raw.find(b"@", m.end() if m else at + 1)
    return out


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = (d - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(raw: bytes) -> bytes:
    return bytes(c for c in raw if 48 <= c <= 57)


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """The seed entities of a text, in bytes; leftmost and non-overlapping in each kind, failing matches dropped."""
    out = [("email", a, b) for a, b in _emails(raw)]
    if _DIGIT.search(raw):
        out += [("ip", *m.span()) for m in _IP.finditer(raw) if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b"."))]
        out += [("card", *m.span()) for m in _CARD.finditer(raw) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if b"+" in raw:
            out += [("phone", *m.span()) for m in _PHONE.finditer(raw) if 9 <= len(_digits(m[0])) <= 15]
    return out


def other_identifiers(raw: bytes, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like mentions that no seed overlaps, in order and apart from each other."""
    out, at = [], 0
    seeds = sorted((a, b) for _, a, b in taken)
    upto, k = 0, 0  # the end of the seeds that begin before a place
    for m in _HIT.finditer(raw):
        if m.start() < at:
            continue
        begin, end = m.start(), m.end()
        while begin > at and end - begin <= LONGEST and raw[begin - 1] not in _BLANK:
            begin -= 1
        if len(m[0]) > 1:  # (at): the word before may stand apart
            near = _AT.search(raw, max(at, begin - LONGEST), min(len(raw), end + LONGEST))
            if not near or not near.start() < m.start() < near.end():
                continue
            begin, end = near.span()
        else:
            while end < len(raw) and end - begin <= LONGEST and raw[end] not in _BLANK:
                end += 1
            for _ in range(GROUPS - 1):
                more = _GROUP.match(raw, end)
                if not more or not (48 <= raw[end - 1] <= 57 or raw[end - 1] == 41):
                    break
                end = more.end()
        at = end
        while begin < end and raw[begin] in _EDGE and raw[begin] != 40:
            begin += 1
        while end > begin and raw[end - 1] in _EDGE:
            end -= 1
        while k < len(seeds) and seeds[k][0] < end:
            upto = max(upto, seeds[k][1])
            k += 1
        mention = raw[begin:end]
        if upto <= begin and 0 < len(mention) <= LONGEST and (len(m[0]) > 1 or b"@" in mention or len(_digits(mention)) >= LEAST_DIGITS):
            out.append((begin, end))
    return out


def is_barred(mention: bytes) -> bool:
    """Whether a base kind's form matches a part of it (whose check then refuses it, else it were a seed)."""
    digits = any(12 <= len(_digits(m[0])) <= 19 for m in _CARD.finditer(mention))
    return digits or _IP.search(mention) is not None or _PHONE.search(mention) is not None


def _plain(word: bytes) -> bytes:
    """A word of a context: lower case, digits as one, without punctuation around it."""
    return word.lower().translate(_DIGITS_AS_ONE).strip(_MARKS) or b"-"


def patterns(raw: bytes, begin: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a mention; those without a word are left out. Contexts reach 200 bytes to either side."""
    before = [_plain(w) for w in raw[max(0, begin - 200) : begin].split()[-2:]]
    after = [_plain(w) for w in raw[end : end + 200].split()[:2]]
    shape = re.sub(rb"(.)\1+", rb"\1+", raw[begin : min(end, begin + LONGEST)].translate(_SHAPE))
    found = []
    if len(before) == 2:
        found.append(b"L" + b"\x00".join(before))
    if len(after) == 2:
        found.append(b"R" + b"\x00".join(after))
    if before and after:
        found.append(b"M" + before[-1] + b"\x00" + after[0])
    if before:
        found.append(b"S" + before[-1] + b"\x00" + shape)
    return [value_hash(f) for f in found]


_MENTIONS = "array<struct<kind:string,start:bigint,end:bigint,value:bigint,barred:boolean,patterns:array<bigint>>>"


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id and all mentions of a document (kind is null where no seed pattern matched); one pass, written."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw"))

    def start():
        def step(batch):
            lists = []
            for raw in batch.column("raw"):
                raw = raw.as_py() or b""
                found = base_spans(raw)
                found += [(None, a, b) for a, b in other_identifiers(raw, found)]
                rows = []
                for (kind, a, b), (_, start_at, end_at) in zip(found, in_code_points(raw, found), strict=True):
                    barred = kind is None and is_barred(raw[a:b])
                    rows.append({"kind": kind, "start": start_at, "end": end_at, "value": value_hash(raw[a:b].lower()), "barred": barred, "patterns": patterns(raw, a, b)})
                lists.append(rows)
            return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "mentions": lists}

        return step

    return save(map_batches(slim, start, f"row bigint, doc_id bigint, mentions {_MENTIONS}"), "pii-mentions")


def confident_patterns(scanned: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT, decay: float = DECAY) -> DataFrame:
    """pattern, kind, confidence of the patterns that act, after so many rounds over the pattern-instance graph (fewer if one changes nothing)."""
    with scratch(scanned.sparkSession) as made:
        mentions = scanned.select(F.explode("mentions").alias("m")).select("m.*")
        edges = mentions.select(F.explode("patterns").alias("pattern"), "value", "kind", "barred").groupBy("pattern", "value").agg(F.min("kind").alias("seed"), F.max("barred").alias("barred"))
        edges = save(edges, "pii-edges")
        size = save(edges.groupBy("pattern").agg(F.count("*").alias("n_instances")).where(F.col("n_instances") >= support), "pii-patterns")
        seeds = save(mentions.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)), "pii-seeds")
        scores, acting, before = seeds, None, None
        best = Window.partitionBy("pattern").orderBy(F.desc("confidence"), "kind")
        for k in range(rounds):
            weights = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
            rated = weights.where(F.col("mass") >= support).join(size, "pattern").withColumn("confidence", F.col("mass") / F.col("n_instances"))
            acting = save(rated.where(F.col("confidence") >= confidence).withColumn("r", F.row_number().over(best)).where("r = 1").select("pattern", "kind", "confidence"), f"pii-acting-{k}")
            now = tuple(acting.agg(F.count("*"), F.round(F.sum("confidence"), 6)).first())
            if now == before or not now[0] or k + 1 == rounds:
                break
            before = now
            marked = edges.where("seed IS NULL AND NOT barred").join(bounded(acting), "pattern").groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("b"))
            new = marked.join(seeds.select("value"), "value", "left_anti").select("value", F.col("b.kind").alias("kind"), (F.lit(decay) * F.col("b.confidence")).alias("score"))
            scores = save(seeds.unionByName(new), f"pii-scores-{k}")
        return made.keep(acting)


def identifiers(docs: DataFrame, **how) -> DataFrame:
    """doc_id and `spans` (kind, start, end; code points) of every row of docs: the seeds, and what acting patterns discover."""
    scanned = scan(docs)
    acting = confident_patterns(scanned, **how)
    unseen = scanned.select("row", F.explode("mentions").alias("m")).where("m.kind IS NULL AND NOT m.barred").select("row", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    best = unseen.join(bounded(acting), "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    added = best.groupBy("row").agg(F.collect_list(F.struct(F.concat(F.lit("found_"), "b.kind").alias("kind"), "start", "end")).alias("added"))
    seeds = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return scanned.join(added, "row", "left").select("doc_id", F.concat(seeds, F.coalesce("added", none)).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base, BASE_KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), BASE_KINDS).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"].startswith("found_"))).cast("long").alias("n_found"),
        F.size("spans").cast("long").alias("n_spans"),
    )
