"""Operator 12, removal of lines that many documents share, by a range-partitioned stream of line hashes.

1. Each document gives one entry for each distinct key of its lines (a 128-bit hash of the stripped, lower-cased line): the key, the
   document and the places of its lines. The entries are written; a task gives a repeated row's entries once.
2. They are partitioned by ranges of (key, document descending, text) and sorted so inside partitions. The document is part of
   the range, so the entries of a very common line spread over as many partitions as their number asks for.
3. Each partition is read as a stream. A key's first entry is of the largest document that has it, which keeps its lines. Its next
   documents wait until LEAST documents have been seen, then they and all later ones are told to drop their lines, at once.
   What a partition can't decide alone, since the key may begin in an earlier one or go on in a later one, leaves it as open,
   and a piece's summary (documents, first, last) goes with it. The summaries, two a partition, decide the open entries.
4. The places to drop are gathered by document into one bitmap of kept lines, compressed. Bitmaps, not texts, are the result; a text is
   read again only where they are applied.

Defined results: a null or empty text is one empty line, which is kept; a null doc_id is one document, smaller than all others; rows with
one doc_id are one document, whichever their texts; repeated rows each get the same bitmap; lines of one document that are
alike are kept or dropped together, so no ties occur; a document whose lines are all dropped becomes the empty text; very long texts are
read whole, and a task holds one text and its line places at a time; an empty table gives no rows. Only doc_id and text are
read; deduplicate() keeps all columns, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import BROADCAST_ROWS, Bounded, bound_batches, discard, give_back, map_batches, save, table, utf8

#: Keys of at least so many code points that are found in at least so many documents.
LONGEST_FREE, LEAST = 40, 5
#: Fixed by the contract: what is stripped at both ends.
BLANK = b" \t\n\x0b\x0c\r"
#: Entries of a key that wait for a decision inside a task; further ones leave it as open.
WAITING = 20_000
#: Bytes of all bitmaps up to which they are broadcast to the documents; beyond, both sides are shuffled.
BROADCAST_BYTES = 64_000_000

ENTRY = "key binary, doc bigint, mark bigint, n_lines bigint, lines binary"


def line_key(line: bytes, longest_free: int = LONGEST_FREE) -> bytes | None:
    """The key's hash; None for keys that are too short."""
    import xxhash

    line = line.strip(BLANK).lower()  # bytes.lower() changes A-Z only
    if len(line) < longest_free or not line.isascii() and len(line) < 4 * longest_free and len(line.decode("utf-8", "replace")) < longest_free:
        return None
    return xxhash.xxh3_128_digest(line)


def _named() -> list[Column]:
    """doc (null as the least number), mark (a hash of the text) and raw of each row."""
    raw = F.coalesce(utf8(), F.lit(b""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(raw).alias("mark"), raw.alias("raw")]


def entries(docs: DataFrame, longest_free: int = LONGEST_FREE) -> DataFrame:
    """One row for each document row and key."""

    def start() -> Callable[[pa.RecordBatch], dict]:
        seen = Bounded(lambda key: True)

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"key": [], "doc": [], "mark": [], "n_lines": [], "lines": []}
            for doc, mark, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (doc, mark) in seen:
                    continue
                seen[doc, mark]
                found: dict[bytes, list[int]] = {}
                lines = raw.as_py().split(b"\n")
                for i, line in enumerate(lines):
                    if len(line) >= longest_free and (key := line_key(line, longest_free)):
                        found.setdefault(key, []).append(i)
                for key, at in found.items():
                    out["key"].append(key)
                    out["lines"].append(np.array(at, "<u4").tobytes())
                out["doc"] += [doc] * len(found)
                out["mark"] += [mark] * len(found)
                out["n_lines"] += [len(lines)] * len(found)
            return out

        return step

    return map_batches(docs.select(*_named()), start, ENTRY)


#: What leaves the stream. state 0: drop; 1: open; 2: a piece's summary, with doc the first and last the last document of n_docs.
DECISION = "state int, key binary, doc bigint, mark bigint, n_lines bigint, lines binary, n_docs bigint, last bigint"


class Piece:
    """A key's entries in one partition, in order, and what is known of them."""

    def __init__(self, key: bytes, opening: bool):
        self.key, self.opening, self.n_docs, self.first, self.last, self.overflowed = key, opening, 0, None, None, False
        self.waiting: list[tuple] = []
        self.previous: tuple | None = None

    def take(self, entry: tuple, least: int) -> Iterator[tuple]:
        """(state, entry) of what can be told."""
        doc = entry[1]
        if (doc, entry[2]) == self.previous:
            return
        self.previous = (doc, entry[2])
        if self.n_docs == 0:
            self.first = doc
        if self.n_docs == 0 or doc != self.last:
            self.n_docs, self.last = self.n_docs + 1, doc
        if doc == self.first:
            if self.opening:  # an earlier partition may hold the largest document
                yield 1, entry
            return
        if self.n_docs < least:
            self.waiting.append(entry)
            if len(self.waiting) > WAITING:
                self.overflowed = True
                yield from ((1, e) for e in self.waiting)
                self.waiting = []
            return
        yield from ((0, e) for e in self.waiting)
        self.waiting = []
        yield 0, entry

    def end(self, closing: bool) -> Iterator[tuple]:
        """What still waits: it stays, unless another partition or the summary knows better."""
        if self.opening or closing or self.overflowed:
            yield from ((1, e) for e in self.waiting)
            yield 2, (self.key, self.first, 0, 0, b"", self.n_docs, self.last)
        self.waiting = []


def stream(batches: Iterator[pa.RecordBatch], least: int = LEAST, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Decisions over one partition's sorted entries."""
    names = DECISION.replace(",", "").split()[::2]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    types = [kinds[k] for k in DECISION.replace(",", "").split()[1::2]]
    out: list[tuple] = []
    piece: Piece | None = None

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        out.clear()
        return made

    def tell(told: Iterator[tuple]) -> None:
        out.extend((state, *(e if len(e) == 7 else (*e, None, None))) for state, e in told)

    for batch in batches:
        for entry in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if piece is None or entry[0] != piece.key:
                if piece is not None:
                    tell(piece.end(False))
                piece = Piece(entry[0], piece is None)
            tell(piece.take(entry, least))
            if len(out) >= rows:
                yield flush()
    if piece is not None:
        tell(piece.end(True))
    if out:
        yield flush()
    give_back()


def dropped(docs: DataFrame, longest_free: int = LONGEST_FREE, least: int = LEAST) -> DataFrame:
    """doc, mark, n_lines, lines: the places to drop, a row for each document and key that loses its lines there. Written."""
    spark = docs.sparkSession
    made = save(entries(docs, longest_free), "line-entries")
    order = [F.col("key"), F.col("doc").desc(), F.col("mark")]
    told = save(bound_batches(made).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: stream(batches, least), DECISION), "line-decisions")
    discard(spark, made)
    pieces = Window.partitionBy("key").orderBy(F.desc("doc"), F.desc("last"))
    again = F.coalesce((F.lag("last").over(pieces) == F.col("doc")).cast("long"), F.lit(0))
    keys = told.where("state = 2").select("key", "doc", (F.col("n_docs") - again).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("doc").alias("largest")).where(F.col("n") >= least)
    keys = save(keys.drop("n"), "line-keys")
    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys  # some two rows of 24 bytes a partition
    late = told.where("state = 1").join(small, "key").where("doc != largest")
    columns = ["doc", "mark", "n_lines", "lines"]
    done = save(told.where("state = 0").select(columns).unionByName(late.select(columns)), "line-drops")
    discard(spark, told, keys)
    return done


def pack(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, lines: pd.Series) -> pd.Series:
    def one(n: int, parts) -> bytes:
        keep = np.ones(n, bool)
        keep[np.frombuffer(b"".join(map(bytes, parts)), "<u4")] = False
        return pack(keep)

    return pd.Series([one(n, p) for n, p in zip(n_lines, lines, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, longest_free: int = LONGEST_FREE, least: int = LEAST) -> DataFrame:
    """doc, mark (hash of the text), n_lines, n_dropped and keep (a compressed bit for each line) of every document text that loses lines;
    all others keep all. Written."""
    drops = dropped(docs, longest_free, least)
    gathered = drops.groupBy("doc", "mark").agg(F.first("n_lines").alias("n_lines"), F.collect_set("lines").alias("lines"))
    size = F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)) / 4
    out = save(bound_batches(gathered).select("doc", "mark", "n_lines", size.cast("long").alias("n_dropped"), _bitmap("n_lines", "lines").alias("keep")), "line-bitmaps")
    discard(docs.sparkSession, drops)
    return out


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (all columns of docs), raw, keep (null: all lines) for each row of docs."""
    named = docs.select(F.struct("*").alias("row"), *_named())
    found = bitmaps.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("keep")).alias("bytes")).first()
    small = found.n <= BROADCAST_ROWS and (found.bytes or 0) <= BROADCAST_BYTES
    slim = bitmaps.select("doc", "mark", "keep")
    return named.join(F.broadcast(slim) if small else slim, ["doc", "mark"], "left").select("row", "raw", "keep")


def kept_text(raw: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The kept text, all lines, dropped lines."""
    if bitmap is None:
        return raw, raw.count(b"\n") + 1, 0
    lines = raw.split(b"\n")
    keep = unpack(bitmap, len(lines))
    return b"\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k), len(lines), int(len(lines) - keep.sum())


def deduplicate(docs: DataFrame, longest_free: int = LONGEST_FREE, least: int = LEAST) -> DataFrame:
    """docs without the dropped lines, with exactly their own columns."""

    @F.pandas_udf("string")
    def kept(raw: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else kept_text(r, k)[0].decode("utf-8", "replace") for r, k in zip(raw, keep, strict=True)], dtype=object)

    joined = bound_batches(with_bitmaps(docs, keep_bitmaps(docs, longest_free, least)))
    text = F.when(F.col("keep").isNotNull(), kept("raw", "keep")).otherwise(F.col("row.text"))
    return joined.select("row", text.alias("kept")).select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = with_bitmaps(docs, keep_bitmaps(docs)).select("row.doc_id", "raw", "keep")

    def start() -> Callable[[pa.RecordBatch], dict]:
        import hashlib

        def step(batch: pa.RecordBatch) -> dict:
            told = [kept_text(raw.as_py(), keep.as_py()) for raw, keep in zip(batch.column(1), batch.column(2), strict=True)]
            return {"doc_id": batch.column(0), "n_lines": [n for _, n, _ in told], "n_dropped": [d for *_, d in told], "kept_sha256": [hashlib.sha256(t).hexdigest() for t, *_ in told]}

        return step

    return map_batches(joined, start, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


OP12_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.doc_id, k.line, k.i, s.key IS NOT NULL AND k.doc_id <> s.largest AS gone FROM k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id
"""
