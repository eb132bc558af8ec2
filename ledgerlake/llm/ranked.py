"""Operator 13, ranked lexical search by a threshold-seeded join of items with an inverted index.

The index has a row for each block of documents: their ids and lengths, and for each term its postings in the block (document, occurrences),
compressed. It is built in one pass where the documents are read, and written to the shared folder.

1. Corpus statistics (documents, terms, documents a term) are sums over the index.
2. Each term's impacts follow from them. Of every term its largest and its k-th largest impact are stored: tasks keep the K largest of their
   blocks, and a grouped top k over those rows gives the term's.
3. An item's k-th score is at least the largest k-th part that one of its terms alone gives: the seed of its threshold. Its terms are put in the
   order of their largest parts; a suffix whose largest parts together stay below the threshold can't bring a document in. So only terms before
   it generate candidates; documents that hold none of them are never looked at.
4. A block meets all items of a slice inside a task. The generating terms' postings are added up, candidates whose sum and remaining bounds stay
   below the threshold go, and the others are scored exactly, term by term, under shrinking bounds. The threshold rises with the K best
   of a task's blocks. Scores equal to it stay, since the smaller doc_id wins.
5. The tasks' K best of each item meet in a grouped top k.

Items come to the tasks in slices of at most SLICE_BYTES of text (or one longer item), by a broadcast of some ten times that size; more items
are a loop over slices, all against one index. No shuffle carries postings or candidates, so no term or document can be hot.

Defined results: null and empty texts have no terms; such documents count in nothing and are not found, such items give no rows. Repeated document
rows are documents each, repeated benchmark rows are ranked each. Equal scores go by ascending doc_id, null last; rows that are equal in
both are alike, and their ranks stay unique. Very long texts are a block of their own. Empty tables give no rows. Only doc_id, text, item_id
and text are read, other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import bound_batches, discard, give_back, save, table, utf8
from ledgerlake.llm.decontaminate import words

K = 20
BLOCK_WORDS = 1 << 18
#: Text of the items that are matched at once, and the most of all items whose terms an index is told beforehand; beyond, it holds all terms.
SLICE_BYTES, VOCABULARY_BYTES = 4_000_000, 16_000_000

_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("n", "<i8")])
INDEX = "n_docs bigint, n_terms bigint, docs binary, postings array<struct<term:binary,df:bigint,data:binary>>"


def build_index(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """A row for each block; documents without terms are left out. With a vocabulary only its terms have postings. One pass, written."""
    shared = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else {w: i for i, w in enumerate(vocabulary)})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        fixed = shared.value
        terms: dict[bytes, int] = {} if fixed is None else fixed
        parts: list[np.ndarray] = []
        listed: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            ords = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            pairs, tf = np.unique((ids * len(parts) + ords)[ids >= 0], return_counts=True)
            of = pairs // len(parts)
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            names = list(terms)
            rows = []
            for a, b in zip(cut.tolist(), [*cut.tolist(), len(of)][1:], strict=True):
                data = np.stack([pairs[a:b] % len(parts), tf[a:b]]).astype("<u4")
                rows.append({"term": names[of[a]], "df": b - a, "data": pack(data.tobytes())})
            out = {"n_docs": [len(listed)], "n_terms": [held], "docs": [pack(np.array(listed, _DOC).tobytes())], "postings": [rows]}
            kind = pa.struct([("term", pa.binary()), ("df", pa.int64()), ("data", pa.binary())])
            return pa.RecordBatch.from_arrays([pa.array(out["n_docs"], pa.int64()), pa.array(out["n_terms"], pa.int64()), pa.array(out["docs"], pa.binary()), pa.array(out["postings"], pa.list_(kind))], names=list(out))

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(raw.as_py() or b"")
                if found:
                    ids = [terms.setdefault(w, len(terms)) for w in found] if fixed is None else [terms.get(w, -1) for w in found]
                    parts.append(np.array(ids, np.int64))
                    listed.append((doc_id or 0, doc_id is not None, len(found)))
                    held += len(found)
                if held >= BLOCK_WORDS:
                    yield flush()
                    parts, listed, held = [], [], 0
                    if fixed is None:
                        terms = {}
        if listed:
            yield flush()
        give_back()

    return save(bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw")).mapInArrow(build, INDEX), "ranked-index")


class Block:
    """One block's postings with their impacts, inside a task."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, wanted):
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        self.docs = np.frombuffer(self.unpack(row["docs"]), _DOC)
        self.penalty = 12 * (75 + (25 * self.docs["n"] * n_docs) // n_terms)
        self.packed = {p["term"]: p["data"] for p in row["postings"] if p["term"] in wanted}
        self.open: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def impacts(self, term: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The term's documents (places in the block, ascending) and its impact in each."""
        if term not in self.open:
            places, tf = np.frombuffer(self.unpack(self.packed[term]), "<u4").reshape(2, -1).astype(np.int64)
            self.open[term] = places, (1_000_000_000 * tf) // (1000 * tf + self.penalty[places])
        return self.open[term]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_statistics(index: DataFrame, terms: list[bytes], n_docs: int, n_terms: int, k: int = K) -> DataFrame:
    """term, df, top and kth (the largest and the k-th largest impact; 0 with fewer than k documents) of those `terms` that occur. Written."""
    shared = index.sparkSession.sparkContext.broadcast(frozenset(terms))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, n_docs, n_terms, shared.value)
                for term in block.packed:
                    of = block.impacts(term)[1]
                    df, known = best.get(term, (0, of[:0]))
                    of = of if len(of) <= k else np.partition(of, len(of) - k)[-k:]
                    known = np.concatenate([known, of])
                    best[term] = df + block.impacts(term)[1].size, known if len(known) <= k else np.partition(known, len(known) - k)[-k:]
        rows = [(t, df if i == 0 else 0, int(x)) for t, (df, top) in best.items() for i, x in enumerate(top)]
        for a in range(0, len(rows), 50_000):
            t, d, x = zip(*rows[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(d, pa.int64()), pa.array(x, pa.int64())], names=["term", "df", "impact"])
        give_back()

    found = save(bound_batches(index).mapInArrow(largest, "term binary, df bigint, impact bigint"), "ranked-impacts")
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("place") <= k)
    bounds = first.groupBy("term").agg(F.max("impact").alias("top"), F.max(F.when(F.col("place") == k, F.col("impact")).otherwise(0)).alias("kth"))
    out = save(found.groupBy("term").agg(F.sum("df").alias("df")).join(bounds, "term"), "ranked-terms")
    discard(index.sparkSession, found)
    return out


class Query:
    """An item's terms by falling largest parts, with the bounds of what follows each and the seed of its threshold."""

    def __init__(self, terms: Counter, known: dict[bytes, tuple[int, int, int]]):
        parts = sorted(((c * known[t][0] * known[t][1], t, c * known[t][0], c * known[t][0] * known[t][2]) for t, c in terms.items() if t in known and known[t][0] > 0), key=lambda p: (-p[0], p[1]))
        self.terms = [(t, w) for _, t, w, _ in parts]
        self.bounds = [*np.cumsum([p[0] for p in parts][::-1])[::-1].tolist(), 0]
        self.seed = max((p[3] for p in parts), default=0)

    def scored(self, block: Block, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the block's documents that reach the threshold (at least 1)."""
        threshold = max(threshold, 1)
        generating = sum(b >= threshold for b in self.bounds[:-1])
        sums = None
        for term, w in self.terms[:generating]:
            if term in block.packed:
                places, impact = block.impacts(term)
                if sums is None:
                    sums = np.zeros(len(block.docs), np.int64)
                sums[places] += w * impact
        if sums is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(sums >= max(1, threshold - self.bounds[generating]))
        score = sums[at]
        for i, (term, w) in enumerate(self.terms[generating:], generating):
            if not len(at):
                break
            if term in block.packed:
                places, impact = block.impacts(term)
                found = np.minimum(np.searchsorted(places, at), len(places) - 1)
                score = score + np.where(places[found] == at, w * impact[found], 0)
                keep = score + self.bounds[i + 1] >= threshold
                at, score = at[keep], score[keep]
        keep = score >= threshold
        return at[keep], score[keep]


class Best:
    """The k best of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.has = k, *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, score: np.ndarray, doc: np.ndarray, has: np.ndarray) -> None:
        if len(score) > 4 * self.k:  # only what can be among the best, ties included
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc, has = score[keep], doc[keep], has[keep]
        score, doc, has = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.has, has)))
        order = np.lexsort((doc, -has, -score))[: self.k]
        self.score, self.doc, self.has = score[order], doc[order], has[order]

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0


def _of_slice(index: DataFrame, items: list[bytes], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """number (place in items), doc_id, score: the k best of every task."""
    counted = [Counter(words(raw)) for raw in items]
    terms = sorted(set().union(*counted))
    stored = term_statistics(index, terms, n_docs, n_terms, k)
    known = {bytes(r.term): (weight(n_docs, r.df), r.top, r.kth) for r in stored.collect()}  # at most the slice's terms
    discard(index.sparkSession, stored)
    shared = index.sparkSession.sparkContext.broadcast(([Query(c, known) for c in counted], frozenset(known)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted = shared.value
        best: dict[int, Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, n_docs, n_terms, wanted)
                for number, query in enumerate(queries):
                    seed = max(query.seed, best[number].least() if number in best else 0)
                    at, score = query.scored(block, seed)
                    if len(at):
                        best.setdefault(number, Best(k)).add(score, block.docs["doc_id"][at], block.docs["has_id"][at])
        for number, b in best.items():
            ids = pa.array(b.doc, pa.int64(), mask=b.has == 0)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(b.score), pa.int64()), ids, pa.array(b.score, pa.int64())], names=["number", "doc_id", "score"])
        give_back()

    return bound_batches(index).mapInArrow(match, "number bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, slice_bytes: int = SLICE_BYTES, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each row of benchmark(item_id, text). Written."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", utf8().alias("raw")).where("raw IS NOT NULL")
    total = items.agg(F.sum(F.length("raw"))).first()[0] or 0
    n_slices = max(1, -(-total // slice_bytes))

    def slice_of(number: int) -> list:
        return items.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(n_slices)) == number).collect()

    vocabulary = sorted({t for s in range(n_slices) for r in slice_of(s) for t in words(bytes(r.raw))}) if total <= vocabulary_bytes else None
    index = build_index(docs, vocabulary)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    parts = []
    for s in range(n_slices):
        rows = slice_of(s)
        of_item = F.broadcast(spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"number bigint, item_id {items.schema['item_id'].dataType.simpleString()}"))
        found = _of_slice(index, [bytes(r.raw) for r in rows], n_docs, n_terms, k)
        by_rank = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
        parts.append(save(top.join(of_item, "number").select("item_id", "rank", "doc_id", "score"), "ranked-best"))
    discard(spark, index)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, r, len(w) AS n, w FROM t WHERE len(w) > 0),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM p, c GROUP BY term, nn),
m AS (SELECT doc_id, r, 100 - 25 + ((25 * n * nn) // ll) AS m FROM d, c),
i AS (SELECT item, item_id, term, count(*) AS k FROM (SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY item, item_id, term),
s AS (SELECT item, item_id, doc_id, p.r, CAST(sum(k * wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM i JOIN f USING (term) JOIN p USING (term) JOIN m ON m.r = p.r GROUP BY item, item_id, doc_id, p.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
