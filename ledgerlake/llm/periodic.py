"""Operator 11, periodic runs of words by the method of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least MIN_LENGTH words and MIN_EXPONENT
periods. A text is cut into Lempel-Ziv factors (each the longest word sequence that occurs earlier, overlaps allowed), read off a suffix
automaton that knows each state's first end. Every run either touches a factor's border or lies strictly inside a factor:

* Main's algorithm finds the first kind around each border, from longest common extensions to both sides. A factor that starts one
  period after a run's start, or later, reaches the run's end; so a run that ends in factor k has at most |k-1| + |k| words after its first
  period. That bounds the periods and the words looked at, and all borders together cost linear time.
* A run strictly inside a factor is a copy of a run inside the factor's earlier occurrence, moved by their distance.

Before that, the text is cut down without loss: a run of the lengths asked for repeats each of some windows of REACH words one period
later, and these windows and their copies cover the run and would cover the words beside it, could they extend it. So only stretches
covered by windows that occur twice in a text can hold runs, and each such stretch is searched on its own.

One map over the documents; no shuffle, so no key or group can be hot. A task holds some 500 bytes for each word of the longest repeated
stretch of one text, and nothing between texts.

Defined results: a null or empty text, or one of blanks, has no words, no runs, null for the best run, and the digests of the empty string. A
null doc_id is kept as null. Very long texts are searched whole. Ties for the best run go to the smallest start, then the smallest period.
Repeated rows get a row each; an empty table gives no rows. Only doc_id and text are read, other columns, whatever their names, are
left aside by runs() and kept by collapse().
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bound_batches, map_batches, table, utf8

MIN_LENGTH, MIN_EXPONENT = 24, 3

Run = tuple[int, int, int]  # start, end (exclusive), smallest period


def reach(min_length: int, min_exponent: int) -> int:
    """Words of any run that lie one period or more after its start, at least."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


def stretches(words: list[bytes], size: int) -> list[tuple[int, int]]:
    """The stretches covered by windows of `size` words that occur at least twice. Equal hashes of different windows only add to them."""
    n = len(words) - size + 1
    if n < 2:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = h ^ (h >> np.uint64(29))
    wide = 1
    while 2 * wide <= size:
        h = (h[:-wide] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[wide:] + (h[wide:] >> np.uint64(31)))
        wide *= 2
    h = h[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + h[size - wide : size - wide + n]
    ordered = np.sort(h)
    twice = ordered[:-1][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.searchsorted(twice, h)
    at[at == len(twice)] = 0
    change = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice[at] == h)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    edge = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def factors(ids: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors as (start, end, start of the first occurrence; its own start if it is a new word)."""
    follow: list[dict[int, int]] = [{}]
    link, length, first, last = [-1], [0], [-1], 0
    for i, c in enumerate(ids):
        new = len(follow)
        follow.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 != length[q]:
                copy = len(follow)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
            else:
                link[new] = q
        last = new
    out, s, n = [], 0, len(ids)
    while s < n:
        state, j = 0, s
        while j < n:
            ahead = follow[state][ids[j]]
            if first[ahead] >= j:
                break
            state, j = ahead, j + 1
        out.append((s, j, first[state] - (j - s) + 1) if j > s else (s, s + 1, s))
        s = max(j, s + 1)
    return out


def _matches(a: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of a and of a from that place on; len(a) at 0."""
    n = len(a)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def touching(ids: list[int], x: int, before: int, after: int, min_length: int, min_exponent: int) -> list[Run]:
    """Runs that start at or before x, end at or after it, and lie in the two factors of `before` and `after` words around x, or reach less
    than a period back before them. Those that reach further belong to other borders."""
    most = (before + after) // (min_exponent - 1)
    low, high, n = max(0, x - before - most - 1), min(len(ids), x + after + 1), len(ids)
    left, right = ids[low:x], ids[x:high]
    back = _matches([*left[::-1], -1, *right[::-1], *left[::-1]])
    ahead = _matches([*right, -1, *left, *right])
    found: dict[tuple[int, int], int] = {}
    n_left, n_right = len(left), len(right)
    for q in range(1, most + 1):
        ends = []
        if q < n_right or q == n_right and high == n:  # x and x + q are compared
            ends.append((x - back[n_left + 1 + n_right - q], x + q + (ahead[q] if q < n_right else 0)))
        if q <= n_left:  # x - q and x are compared
            ends.append((x - q - (back[q] if q < n_left else 0), x + ahead[n_right + 1 + n_left - q] if n_right else x))
        for b, e in ends:
            if e - b >= min_length and e - b >= min_exponent * q and (b > low or low == 0) and (e < high or high == n):
                found.setdefault((b, e), q)
    return [(b, e, q) for (b, e), q in found.items()]


def runs_of_ids(ids: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """All runs of a sequence of numbers, by start, then period."""
    cut, least = factors(ids), reach(min_length, min_exponent)
    known: dict[tuple[int, int], int] = {}
    ordered: list[Run] = []
    before = 0
    for start, end, source in [*cut, (len(ids), len(ids), len(ids))]:
        if before + end - start >= least:
            for b, e, q in touching(ids, start, before, end - start, min_length, min_exponent):
                if (b, e) not in known:
                    known[b, e] = q
                    insort(ordered, (b, e, q))
        move = start - source
        if move and end - start >= min_length:
            i = bisect_right(ordered, (source, len(ids) + 1, 0))
            while i < len(ordered) and ordered[i][0] + min_length < end - move:
                b, e, q = ordered[i]
                if e < end - move and (b + move, e + move) not in known:
                    known[b + move, e + move] = q
                    insort(ordered, (b + move, e + move, q))
                i += 1
        before = end - start
    return ordered


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """All runs of a text's words, by start, then period."""
    out: list[Run] = []
    for begin, end in stretches(words, reach(min_length, min_exponent)):
        if end - begin >= min_length:
            seen: dict[bytes, int] = {}
            ids = [seen.setdefault(w, len(seen)) for w in words[begin:end]]
            out += [(b + begin, e + begin, q) for b, e, q in runs_of_ids(ids, min_length, min_exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for b, e, q in found:
        change[b + q] += 1
        change[e] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def plain_words(doc_id: int | None, raw: bytes) -> list[bytes]:
    return raw.split()


RUNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_sha256 string"


def runs(docs: DataFrame, words_of: Callable[[int | None, bytes], list[bytes]] = plain_words, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, all runs by start and period, and the digest of the words that collapsing keeps, for each row of docs(doc_id, text)."""

    def start() -> Callable[[pa.RecordBatch], dict]:
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": batch.column(0), "n_words": [], "runs": [], "collapsed_sha256": []}
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(doc_id, raw.as_py() or b"")
                found = runs_of(words, min_length, min_exponent)
                out["n_words"].append(len(words))
                out["runs"].append([{"start": b, "length": e - b, "period": q} for b, e, q in found])
                out["collapsed_sha256"].append(hashlib.sha256(b" ".join(kept_words(words, found))).hexdigest())
            return out

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw")), start, RUNS)


def collapse(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with each text that holds runs replaced by its kept words, joined by blanks; other texts and all other columns stay."""

    @F.pandas_udf("string")
    def collapsed(raw: pd.Series) -> pd.Series:
        def one(x: bytes | None) -> str | None:
            words = (x or b"").split()
            found = runs_of(words, min_length, min_exponent)
            return b" ".join(kept_words(words, found)).decode("utf-8", "replace") if found else None

        return raw.map(one)

    text = F.coalesce(collapsed(utf8()), F.col("text"))
    return bound_batches(docs).select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def best(found: str = "runs"):
    """The run of the greatest exact exponent; ties by start, then period (the runs come in that order). Null without runs."""
    less = lambda a, b: (b["length"] * a["period"]) > (a["length"] * b["period"])  # noqa: E731  cross products: exact
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(F.col(found), none, lambda a, b: F.when(a.isNull() | less(a, b), b).otherwise(a))


def _planted_words(doc_id: int | None, raw: bytes) -> list[bytes]:
    """The contract's text: the words, for a tenth of the documents repeated periodically from some word on. A null doc_id changes nothing."""
    words = raw.split()
    h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h < 0 or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents"), _planted_words).withColumn("best", best())
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


#: DuckDB has no crc32; this is its bitwise form over the digits of a doc_id (polynomial 0xEDB88320).
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda s, c: list_reduce([xor(s, c), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, one: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

OP11_SQL = f"""
WITH w0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, xor({_CRC}, 4294967295) AS h FROM documents),
w1 AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM w0),
w2 AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END + 1]) END AS w FROM w1),
grams AS (SELECT doc_id, i, hash(array_to_string(w[i + 1:i + 16], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, n - 15)) AS i FROM w2 WHERE n >= 24)),
again AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
islands AS (SELECT doc_id, q, min(i) AS b, max(i) + q + 16 AS e FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM again) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, b, e - b AS len, min(q) AS q FROM islands WHERE e - b >= greatest(24, 3 * q) GROUP BY doc_id, b, e),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(b || ',' || len || ',' || q || chr(10), '' ORDER BY b, q) AS lines FROM runs GROUP BY doc_id),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, b, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(b + q, b + len)) AS i FROM runs),
pos AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM w2),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS t FROM pos p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT w2.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.b AS BIGINT) AS start, CAST(top.len AS BIGINT) AS length, CAST(top.q AS BIGINT) AS period,
       CAST(1000 * top.len // top.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM w2 LEFT JOIN told ON w2.doc_id = told.doc_id LEFT JOIN top ON w2.doc_id = top.doc_id LEFT JOIN kept ON w2.doc_id = kept.doc_id
"""
