"""Operator 10, secret scans with corpus-wide ownership frequency.

One pass finds candidate secrets: the base kinds of the contract, and further credential shapes (private keys, JSON web tokens,
prefixed service tokens). Each candidate's value is hashed; hashes are aggregated over the whole corpus by distinct
repositories and owners. A value that many owners hold is a copied example; one that a single owner holds, with a
mixed alphabet and no sample word in it, looks live.

Hot values are combined before the shuffle (distinct hash, owner, repository first). Only values that more than one owner or
repository holds are joined with their mentions again, broadcast as long as they are few; the others have one of each. So a value in a
third of all documents costs no more than another.

Defined results: a null or empty text has no candidates; repeated rows count once an owner; a null owner or repository
is one of its own; an empty table gives no rows; very long texts are scanned whole, one at a
time; spans are told by start, then kind, so no ties occur. Only the named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded, map_batches, save, table, utf8
from ledgerlake.llm.spans import count_kind, in_code_points, joined, value_hash

#: The base kinds, in the order of the contract.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # maximal runs: the same as [0-9a-f]+ of 16 or more
_HINTS = (b"passw", b"secret", b"token", b"api")

#: Kinds that the method adds: hints of which one must occur, and the pattern, whose group 1 is the value. Service tokens are known by
#: the prefixes that their issuers publish.
ADDED = {
    "jwt": ((b"eyJ",), re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    # With its END line up to there; without one only lines that are long runs of base64 belong to it.
    "private_key": (
        (b"PRIVATE KEY-----",),
        re.compile(rb"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\s+[A-Za-z0-9+/]{40,76}={0,2}(?![^\s-]))*(?:\s+[A-Za-z0-9+/]{1,76}={0,2}(?=\s*-----END ))?(?:\s*-----END [A-Z ]{0,20}PRIVATE KEY-----)?)"),
    ),
    "service": (
        (b"gh", b"_live_", b"_test_", b"xox", b"glpat-", b"AIza", b"npm_"),
        re.compile(rb"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}[A-Za-z0-9]|glpat-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36})"),
    ),
}
#: Values with one of these in them are samples.
SAMPLE_WORDS = (b"example", b"sample", b"dummy", b"changeme", b"xxxx", b"1234567890")
#: From so many distinct owners a value counts as a copied example.
EXAMPLE_OWNERS = 3


def candidates(raw: bytes) -> list[tuple[str, int, int, bytes]]:
    """(kind, start, end, value) in bytes, leftmost and non-overlapping in each kind."""
    out = []
    low = raw.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(raw) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(raw)]
    for kind, (hints, pattern) in ADDED.items():
        if any(h in raw for h in hints):
            out += [(kind, *m.span(1), m[1]) for m in pattern.finditer(raw)]
    return out


def looks_random(value: bytes) -> bool:
    """At least six different characters, and no sample word."""
    low = value.lower()
    return len(set(low)) >= 6 and not any(w in low for w in SAMPLE_WORDS)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:bigint,random:boolean>>"


def scan(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """A row for each document: row, doc_id, owner, repository and its candidates; one pass, written to the shared folder."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), utf8().alias("raw"))

    def start():
        def step(batch):
            lists = []
            for raw in batch.column("raw"):
                raw = raw.as_py() or b""
                found = candidates(raw)
                placed = in_code_points(raw, [f[:3] for f in found])
                lists.append([{"kind": k, "start": a, "end": b, "value": value_hash(v), "random": looks_random(v)} for (k, a, b), (*_, v) in zip(placed, found, strict=True)])
            return {n: batch.column(n) for n in ("row", "doc_id", "owner", "repository")} | {"spans": lists}

        return step

    return save(map_batches(slim, start, f"row bigint, doc_id bigint, owner string, repository string, spans {_SPANS}"), "secret-spans")


def ownership(scanned: DataFrame) -> DataFrame:
    """value -> how many distinct owners and repositories hold it, corpus-wide."""
    held = scanned.select("owner", "repository", F.explode("spans").alias("s")).select(F.col("s.value").alias("value"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository"))
    return held.distinct().groupBy("value").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))


def judged(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row a candidate: row, kind, start, end, value, n_owners, n_repositories, verdict (example, live or weak)."""
    each = scanned.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    several = bounded(save(ownership(scanned).where("n_owners > 1 OR n_repositories > 1"), "secret-owners"))
    each = each.join(several, "value", "left").withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("n_owners", "n_repositories")})
    copied = F.col("n_owners") >= example_owners
    verdict = F.when(copied, "example").when(F.col("random") & (F.col("n_owners") == 1), "live").otherwise("weak")
    return each.select("row", "kind", "start", "end", "value", "n_owners", "n_repositories", verdict.alias("verdict"))


def secrets_report(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """doc_id, its spans (array of structs) and how many of them are live or examples, for each row of docs."""
    scanned = scan(docs, owner, repository)
    verdicts = judged(scanned).groupBy("row").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "example")], F.max("n_owners").alias("most_owners"))
    zero = F.lit(0).cast("long")
    return scanned.join(verdicts, "row", "left").select("doc_id", "spans", *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "most_owners")])


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_report(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base, BASE_KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), BASE_KINDS).alias("spans"),
        "n_live",
        "n_example",
        "most_owners",
        F.size("spans").cast("long").alias("n_spans"),
    )
