"""Operator 4, benchmark decontamination by a distributed positional inverted index.

The index has a row for each block of documents and each term: the term's positions in the block, as compressed gaps. Blocks hold
about BLOCK_WORDS words (or one longer document), are built where the documents are read, and are written to the shared folder. An
index for a known test set stores the postings of the test set's terms only, since no other term can take part in a match; with
no vocabulary it stores all.

A block visits only the phrases whose rarest term (corpus-wide) it holds. A phrase is matched from that term's postings, moved by its
offset; each further term in order of rarity keeps the starts that its own moved postings contain. Proximity matches start from the
rarest term's postings too and ask for every other term within `slop` words in the same document.

The test set comes to the tasks in slices of at most SLICE_BYTES of text, by a broadcast of some ten times that size (13 numbers a
window). A larger test set is a loop over slices, all matched against one index, whose hits are merged for each document.

Defined results: null and empty texts have no words and are clean; an item without words never occurs; an item_id counts once
however often it is repeated, a null item_id as the empty string; repeated document rows are judged each; an empty table of
documents gives no rows, an empty benchmark leaves all clean. Only the named columns are read; decontaminate() keeps all,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import bound_batches, bounded, give_back, save, scratch, table, utf8

WINDOW = 13
BLOCK_WORDS = 1 << 19
#: Text of the test set that is matched at once, and the most of it whose terms an index is told beforehand; beyond, it holds all terms.
SLICE_BYTES, VOCABULARY_BYTES = 4_000_000, 16_000_000
#: Contaminated from this share of hit words on: PER * n_hit >= n_words.
PER = 20

#: Fixed by the contract: lower-case A-Z; words are runs of digits, a-z and everything beyond ASCII; the rest is blank here.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TO_WORDS).split()


_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("n_words", "<i8"), ("mark", "<i8")])
INDEX = "block bigint, term binary, n bigint, data binary"


def build_index(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """block, term, n (postings) and data; a block's row without a term lists its documents. One pass, written."""
    shared = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else {w: i for i, w in enumerate(vocabulary)})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard
        from pyspark import TaskContext

        fixed = shared.value
        pack = zstandard.ZstdCompressor(level=1).compress
        block = TaskContext.get().partitionId() << 32
        terms: dict[bytes, int] = {} if fixed is None else fixed
        parts: list[np.ndarray] = []
        listed: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            places = np.flatnonzero(ids >= 0)
            ids = ids[places]
            order = np.argsort(ids, kind="stable")
            ids, places = ids[order], places[order]
            cut = np.flatnonzero(np.diff(ids)) + 1
            begins = np.concatenate([[0], cut])[: len(ids)].astype(np.int64)
            ends = np.append(cut, len(ids))[: len(begins)]
            names = list(terms)
            rows = [(names[ids[a]], b - a, pack(np.diff(places[a:b], prepend=0).astype("<u4").tobytes())) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            rows.append((None, len(listed), pack(np.array(listed, _DOC).tobytes())))
            return pa.RecordBatch.from_pydict({"block": pa.array([block] * len(rows), pa.int64()), "term": pa.array([r[0] for r in rows], pa.binary()), "n": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})

        gap = np.array([-1], np.int32)  # between documents, so that no phrase reaches over
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py() or b""
                found = words(raw)
                ids = [terms.setdefault(w, len(terms)) for w in found] if fixed is None else [terms.get(w, -1) for w in found]
                parts += [np.array(ids, np.int32), gap]
                listed.append((doc_id or 0, doc_id is not None, len(found), zlib.crc32(raw)))
                held += len(found) + 1
                if held >= BLOCK_WORDS:
                    yield flush()
                    block, parts, listed, held = block + 1, [], [], 0
                    if fixed is None:
                        terms = {}
        if listed:
            yield flush()
        give_back()

    return save(bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw")).mapInArrow(build, INDEX), "postings")


class Block:
    """One block's postings and documents, inside a task."""

    def __init__(self, rows: pd.DataFrame):
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        listed = rows[rows.term.isna()]
        self.docs = np.concatenate([np.frombuffer(self.unpack(d), _DOC) for d in listed.data]) if len(listed) else np.zeros(0, _DOC)
        self.begins = np.concatenate([[0], np.cumsum(self.docs["n_words"] + 1)])
        self.packed = {bytes(t): d for t, d in zip(rows.term, rows.data, strict=True) if t is not None}
        self.open: dict[bytes, np.ndarray] = {}

    def postings(self, term: bytes) -> np.ndarray | None:
        if term not in self.packed:
            return None
        if term not in self.open:
            self.open[term] = np.cumsum(np.frombuffer(self.unpack(self.packed[term]), "<u4").astype(np.int64))
        return self.open[term]

    def phrase(self, by_rarity: list[tuple[bytes, int]]) -> np.ndarray:
        """Starts of exact occurrences of a phrase, given as (term, offset), rarest first."""
        if any(t not in self.packed for t, _ in by_rarity):
            return np.zeros(0, np.int64)
        (term, offset), *rest = by_rarity
        starts = self.postings(term) - offset
        for term, offset in rest:
            if not len(starts):
                break
            starts = starts[_among(starts + offset, self.postings(term))]
        return starts

    def near(self, by_rarity: list[bytes], slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term within `slop` words in their document."""
        if any(t not in self.packed for t in by_rarity):
            return np.zeros(0, np.int64)
        at = self.postings(by_rarity[0])
        doc = self.document(at)
        low, high = np.maximum(at - slop, self.begins[doc]), np.minimum(at + slop, self.begins[doc + 1] - 2)
        ok = np.ones(len(at), bool)
        for term in by_rarity[1:]:
            other = self.postings(term)
            ok &= np.searchsorted(other, high, "right") > np.searchsorted(other, low, "left")
        return at[ok]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values


def rarity(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Postings of each of these terms (a slice's) in the whole corpus; terms that do not occur are left out."""
    wanted = F.broadcast(index.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.binary())})))
    return {bytes(r.term): r.n for r in index.join(wanted, "term").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def windows(item_words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not item_words:
        return []
    return [tuple(item_words[i : i + size]) for i in range(max(1, len(item_words) - size + 1))]


def plan_of(phrases: dict[tuple[bytes, ...], list[str]], counts: dict[bytes, int]) -> tuple:
    """A slice's windows as plain data for a broadcast: the terms by rarity; the terms' numbers of each window, windows with one rarest
    term side by side; these runs as (rarest term, begin, end); the items of each window."""
    terms = sorted(counts, key=lambda t: (counts[t], t))
    number = {t: i for i, t in enumerate(terms)}
    able = sorted((min(number[t] for t in w), w, sorted(set(items))) for w, items in phrases.items() if all(t in number for t in w))
    rows = np.full((len(able), max((len(w) for _, w, _ in able), default=0)), -1, np.int32)
    for i, (_, w, _) in enumerate(able):
        rows[i, : len(w)] = [number[t] for t in w]
    rarest = np.array([r for r, *_ in able], np.int64)
    cut = [0, *(np.flatnonzero(np.diff(rarest)) + 1).tolist(), len(able)]
    runs = [(terms[rarest[a]], a, b) for a, b in zip(cut, cut[1:]) if a < b]
    return terms, rows, runs, [items for *_, items in able]


def of_block(plan: tuple, block: Block) -> Iterator[tuple[list[tuple[bytes, int]], int, list[str]]]:
    """(terms with their offsets, rarest first; length; items) of the windows whose rarest term the block holds."""
    terms, rows, runs, items = plan
    for rarest, begin, end in runs:
        if rarest in block.packed:
            for i in range(begin, end):
                row = rows[i][rows[i] >= 0]
                yield [(terms[row[k]], int(k)) for k in np.argsort(row, kind="stable")], len(row), items[i]


_HITS = "doc_id bigint, n_words bigint, mark bigint, n_hit bigint, items array<string>, spans array<bigint>"


def _hits_of_slice(index: DataFrame, phrases: dict[tuple[bytes, ...], list[str]], with_spans: bool) -> DataFrame:
    """A row for each document: its hit words and the items of this slice that occur in it."""
    shared = index.sparkSession.sparkContext.broadcast(plan_of(phrases, rarity(index, sorted({t for w in phrases for t in w}))))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows)
        hit = np.zeros(int(block.begins[-1]) + 1, bool)
        found: dict[int, set] = {}
        for by_rarity, length, ids in of_block(shared.value, block):
            starts = block.phrase(by_rarity)
            if len(starts):
                for k in range(length):
                    hit[starts + k] = True
                for d in np.unique(block.document(starts)).tolist():
                    found.setdefault(d, set()).update(ids)
        sums = np.concatenate([[0], np.cumsum(hit)])
        n_hit = sums[block.begins[1:]] - sums[block.begins[:-1]]
        spans = [None] * len(block.docs)
        if with_spans:
            for d in found:
                edge = np.diff(np.concatenate([[0], hit[block.begins[d] : block.begins[d + 1]], [0]]).astype(np.int8))
                spans[d] = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()
        ids = [int(x) if has else None for x, has in zip(block.docs["doc_id"], block.docs["has_id"], strict=True)]
        items = [sorted(found[d]) if d in found else [] for d in range(len(ids))]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": block.docs["n_words"], "mark": block.docs["mark"], "n_hit": n_hit, "items": items, "spans": spans})

    return index.groupBy("block").applyInPandas(match, _HITS)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slice_bytes: int = SLICE_BYTES, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """doc_id, n_words, mark (crc32 of the text), n_hit, items of every row of docs(doc_id, text)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8().alias("raw")).where("raw IS NOT NULL")
    total = items.agg(F.sum(F.length("raw"))).first()[0] or 0
    n_slices = max(1, -(-total // slice_bytes))

    def slice_of(k: int) -> dict[tuple[bytes, ...], list[str]]:
        phrases: dict[tuple[bytes, ...], list[str]] = {}
        for r in items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(n_slices)) == k).collect():
            for w in windows(words(bytes(r.raw)), size):
                phrases.setdefault(w, []).append(r.item)
        return phrases

    if n_slices == 1:
        phrases = slice_of(0)
        return _hits_of_slice(build_index(docs, sorted({t for w in phrases for t in w})), phrases, False).drop("spans")
    vocabulary = sorted({t for k in range(n_slices) for w in slice_of(k) for t in w}) if total <= vocabulary_bytes else None
    index = build_index(docs, vocabulary)
    slices = [_hits_of_slice(index, slice_of(k), True) for k in range(n_slices)]
    every = slices[0].withColumn("slice", F.lit(0))
    for k, s in enumerate(slices[1:], 1):
        every = every.unionByName(s.withColumn("slice", F.lit(k)))
    key = ["doc_id", "n_words", "mark"]
    copies = Window.partitionBy(*key, "slice").orderBy("n_hit")  # repeated rows: copy by copy
    merged = every.withColumn("copy", F.row_number().over(copies)).groupBy(*key, "copy").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list(F.coalesce("spans", F.array().cast("array<bigint>")))).alias("spans"))

    @F.pandas_udf("bigint")
    def covered(spans: pd.Series) -> pd.Series:
        def one(s):
            s = np.asarray(s, np.int64).reshape(-1, 2)
            s = s[np.argsort(s[:, 0])]
            end = np.maximum.accumulate(np.concatenate([[0], s[:, 1]]))
            return int(np.maximum(0, s[:, 1] - np.maximum(s[:, 0], end[:-1])).sum())

        return spans.map(one)

    return merged.select(*key, covered("spans").alias("n_hit"), "items")


def is_contaminated(per: int = PER):
    return (F.col("n_hit") > 0) & (per * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs that are clean, with exactly their own columns."""
    with scratch(docs.sparkSession) as made:
        bad = made.keep(save(hits(docs, benchmark).where(is_contaminated()).select(F.col("doc_id").alias("bad"), F.col("mark").alias("bad_mark")).distinct(), "contaminated"))
    bad = bounded(bad, broadcast_rows)  # 16 bytes a row; beyond it both sides are shuffled
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.crc32(F.coalesce(utf8(), F.lit(b""))).alias("mark"))
    same = F.col("id").eqNullSafe(F.col("bad")) & (F.col("mark") == F.col("bad_mark"))
    return packed.join(bad, same, "left_anti").select("row.*")


def phrase_matches(index: DataFrame, phrases: dict[str, str], slop: int | None = None) -> DataFrame:
    """name, doc_id, position (in words) of exact phrase matches, or with `slop` of proximity matches, in a built index."""
    listed = {n: words(p.encode()) for n, p in phrases.items()}
    counts = rarity(index, sorted({t for w in listed.values() for t in w}))
    plan = {n: sorted(((t, k) for k, t in enumerate(w)), key=lambda x: (counts[x[0]], x[1])) for n, w in listed.items() if w and all(t in counts for t in w)}

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        block, out = Block(rows), []
        for name, by_rarity in plan.items():
            at = block.phrase(by_rarity) if slop is None else block.near(list(dict.fromkeys(t for t, _ in by_rarity)), slop)
            for d, p in zip(block.document(at).tolist(), at.tolist(), strict=True):
                out.append((name, int(block.docs["doc_id"][d]), p - int(block.begins[d])))
        return pd.DataFrame(out, columns=["name", "doc_id", "position"])

    return index.groupBy("block").applyInPandas(match, "name string, doc_id bigint, position bigint")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP4_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
