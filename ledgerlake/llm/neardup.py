"""Operator 5, MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

A text's set is its distinct 5-word shingles, as 64-bit hashes. Texts with equal sets form a class; classes, not texts,
are compared. HASHES universal hashes of a class's shingles give its minima, ROWS minima make a band, and classes that share a
band are candidates. At the similarity asked for, a pair shares no band with a probability of 5 in a million.

Links are confirmed on full sets, and no bucket is turned into all its pairs:
1. stars: each class of a bucket is compared with the bucket's least class. The links found give first components.
2. Buckets that still hold several components. Their classes get a long signature of one bit a hash, and those outside a bucket's
   largest component are compared with the whole bucket, in tiles of bounded size inside tasks.
   a. Each of them names one partner: of those that are clearly similar the least, else the best. Classes that are alike name the
      same partner, so a group of copies beside a bucket's least class comes together through as many pairs as it has rows.
   b. Over what is then still apart, the classes of all pairs that may be similar enough (each at its first common band) meet
      once more in tiles, with their full sets. A task compares those pairs exactly and gives one link between two components,
      so neither the pairs that fail nor all that hold leave it.
So no candidate link between components is lost.

Nodes are classes: the least doc_id of a class, or a number from 2^62 on where another class has that doc_id too (ids must lie
below). Rows are found again by doc_id. Defined results: a null or empty text has an empty set, is linked with nothing and is
kept; a row without a doc_id is linked with nothing, has no component and is kept; texts under one doc_id are one document (their
classes are linked); repeated rows are each returned by near_duplicates() and one of them is kept by deduplicate(); ties do not
occur, as the least doc_id decides; an empty table gives no rows; very long texts have all their shingles in their set, of which a
task holds a few at a time. Only doc_id and text are read; deduplicate() keeps all columns,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded, discard, give_back, map_batches, save, scratch, table, utf8
from ledgerlake.llm.components import components
from ledgerlake.llm.words import groups, hashes, mix, places, runs

WORDS = 5
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: The long signature of the classes in mixed buckets has one bit for each of so many hashes. Sets of similarity s agree in
#: (1 + s) / 2 of the bits. Pairs that differ in more than MOST_BITS (similarity under 0.675, five deviations below PERCENT) are not
#: confirmed; up to CLEAR_BITS (0.83, five above) they are clearly similar. The first FIRST_WORDS words are compared first, of whose
#: bits no more than FIRST_BITS (six deviations) may differ.
LONG_HASHES, MOST_BITS, CLEAR_BITS = 2048, 332, 174
FIRST_WORDS, FIRST_BITS = 4, 64
#: Classes of a tile: a task compares at most TILE classes of other components with SLICE classes of a bucket at once.
TILE, SLICE = 512, 2048
#: Shingles of a tile's and of a slice's full sets (8 bytes each) on average, as classes are dealt by hash; one set may be longer.
SET_TILE, SET_SLICE = 1 << 19, 1 << 20
#: Shingles whose hash minima are taken together.
RUN = 1 << 15

_rng = np.random.default_rng(20_240_501)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(1, 1 << 31, HASHES + LONG_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(1, 1 << 32, HASHES + LONG_HASHES, dtype=np.uint32)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a binary column the sorted distinct hashes of its shingles; of all its words where there are fewer."""
    for data, offsets in groups(column):
        begins, ends, counts = places(data, offsets)
        yield from runs(hashes(data, begins, ends), counts, WORDS, _PLACE)


def shingles(raw: bytes) -> np.ndarray:
    return next(shingle_sets(pa.array([raw], pa.binary())))


def minima(sets: list[np.ndarray], first: int = 0, last: int = HASHES) -> np.ndarray:
    """The least value of universal hashes first to last (a x + b modulo 2^32) over each set; a row a set, none of them empty."""
    out = np.empty((len(sets), last - first), np.uint32)
    i = 0
    while i < len(sets):
        j, held = i, 0
        while j < len(sets) and (j == i or held + len(sets[j]) <= RUN):
            held += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        h = np.empty_like(x)
        for k in range(first, last):
            np.multiply(x, _A[k], out=h)
            np.add(h, _B[k], out=h)
            out[i:j, k - first] = np.minimum.reduceat(h, at)
        i = j
    return out


def band_keys(best: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of minima."""
    bands = best.reshape(len(best), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return key.view(np.int64)


def long_bits(sets: list[np.ndarray]) -> list[bytes]:
    """One bit of each of LONG_HASHES minima, as bytes."""
    best = minima(sets, HASHES, HASHES + LONG_HASHES)
    return [row.tobytes() for row in np.packbits((best * np.uint32(0x9E3779B1)) >> np.uint32(31) > 0, axis=1)]


def digest(found: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), class (digest of the set), bands (a 64-bit key each), for each row of docs."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw"))

    def start():
        def step(batch):
            sets = list(shingle_sets(batch.column("raw")))
            full = [s for s in sets if len(s)]
            none = pa.array([not len(s) for s in sets], pa.bool_())
            lengths = np.array([BANDS if len(s) else 0 for s in sets], np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            keys = band_keys(minima(full)).ravel()
            return {
                "doc_id": batch.column("doc_id"),
                "n": [len(s) for s in sets],
                "class": [digest(s) if len(s) else None for s in sets],
                "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys, pa.int64()), mask=none),
            }

        return step

    return map_batches(slim, start, "doc_id bigint, n bigint, class binary, bands array<bigint>")


def _of_classes(docs: DataFrame, nodes: DataFrame, classes: DataFrame, make, column: str) -> DataFrame:
    """node, `column`: make([set, ...]) of each class in `nodes`, from the text of its least doc_id."""
    wanted = save(nodes.join(classes, "node").select("node", "rep", "class"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), utf8().alias("raw")).join(bounded(wanted), "rep")

    def start():
        def step(batch):
            sets = list(shingle_sets(batch.column("raw")))
            right = [i for i, of in enumerate(batch.column("class").to_pylist()) if digest(sets[i]) == of]
            made: list = [None] * len(sets)
            for i, value in zip(right, make([sets[i] for i in right]) if right else (), strict=True):
                made[i] = value
            return {"node": batch.column("node"), column: made}

        return step

    return map_batches(texts, start, f"node bigint, {column} binary").where(F.col(column).isNotNull())


def confirm(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the written pairs (u, v: nodes) whose full sets are similar enough.

    Sets are made again from the texts of the documents concerned, and each u's set goes to its v's.
    """
    with scratch(docs.sparkSession) as made:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        sets = _of_classes(docs, ends, classes, lambda found: [s.tobytes() for s in found], "set")
        few = bounded(pairs)
        left = sets.join(few.select(F.col("u").alias("node"), F.col("v").alias("other")), "node").select(F.col("other").alias("v"), F.col("node").alias("u"), F.col("set").alias("a"))
        targets = save(pairs.select(F.col("v").alias("node")).distinct(), "pair-targets")
        right = sets.join(bounded(targets), "node").select(F.col("node").alias("v"), F.col("set").alias("b"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for a, b in zip(batch.column(2), batch.column(3), strict=True):
                    a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                    both = np.sort(np.concatenate([a, b]))
                    common = np.count_nonzero(both[1:] == both[:-1])
                    keep.append(100 * common >= PERCENT * (len(both) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))
            give_back()

        return made.keep(save(left.join(right, "v").select("u", "v", "a", "b").mapInArrow(compare, "u bigint, v bigint").distinct(), "confirmed"))


def _sizes_fit(a, b):
    """Sets whose sizes differ too much can't be similar enough."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _column(found: pa.Table, name: str, dtype, width: int = 1) -> np.ndarray:
    """A column without nulls as an array; lists and bytes of one length as rows."""
    whole = found.column(name).combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    if pa.types.is_binary(whole.type) or pa.types.is_large_binary(whole.type):
        return np.frombuffer(b"".join(whole.to_pylist()), dtype).reshape(len(whole), width)
    if pa.types.is_list(whole.type) or pa.types.is_large_list(whole.type):
        return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), width)
    return whole.to_numpy(zero_copy_only=False)


def _agreeing(first: np.ndarray, bits: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which classes differ from `one` in MOST_BITS at most, and in how many. bits: (classes, words); first: (FIRST_WORDS, classes)."""
    differ = np.bitwise_count(first[0] ^ one[0]).astype(np.uint16)
    for w in range(1, FIRST_WORDS):
        differ += np.bitwise_count(first[w] ^ one[w])
    near = np.flatnonzero(differ <= FIRST_BITS)
    differ = np.bitwise_count(bits[near] ^ one).sum(axis=1, dtype=np.int32)
    return near[differ <= MOST_BITS], differ[differ <= MOST_BITS]


_NAMED = pa.schema([("u", pa.int64()), ("unclear", pa.int32()), ("v", pa.int64())])
_MET = pa.schema([("key", pa.int64()), ("node", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _candidates(found: pa.Table, first_bands: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a tile: each class outside the main component, its component, and the nodes, components and differing bits of the
    classes of other components that may be similar enough; with first_bands, of those that meet it in no earlier band."""
    minor = _column(found, "minor", bool)
    mine, every = found.filter(pa.array(minor)), found.filter(pa.array(~minor))
    if not len(mine) or not len(every):
        return
    band = int(found.column("band")[0].as_py())
    node, n, comp = (_column(every, c, np.int64) for c in ("node", "n", "component"))
    bits = _column(every, "long", np.uint64, LONG_HASHES // 64)
    first = np.ascontiguousarray(bits[:, :FIRST_WORDS].T)
    keys, my_keys = _column(every, "earlier", np.int64, band), _column(mine, "earlier", np.int64, band)
    my_bits = _column(mine, "long", np.uint64, LONG_HASHES // 64)
    for i, (u, nu, cu) in enumerate(zip(*(_column(mine, c, np.int64).tolist() for c in ("node", "n", "component")), strict=True)):
        other, differ = _agreeing(first, bits, my_bits[i])
        fits = (comp[other] != cu) & (100 * n[other] >= PERCENT * nu) & (100 * nu >= PERCENT * n[other])
        if first_bands and band:
            fits &= ~(keys[other] == my_keys[i]).any(axis=1)
        if fits.any():
            yield u, cu, node[other[fits]], comp[other[fits]], differ[fits]


def _partners(found: pa.Table) -> pa.Table:
    """u, unclear (0, or the differing bits), v: the least clearly similar class of another component, else the best."""
    rows = []
    for u, _, node, _, differ in _candidates(found, False):
        clear = node[differ <= CLEAR_BITS]
        rows.append((u, 0, int(clear.min())) if len(clear) else (u, int(differ.min()), int(node[differ == differ.min()].min())))
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table(dict(zip(_NAMED.names, map(list, columns), strict=True)), _NAMED)


def _met(found: pa.Table) -> pa.Table:
    """key, node: the classes with a partner that may be similar enough, and those partners."""
    nodes: set[int] = set()
    for u, _, node, _, _ in _candidates(found, True):
        nodes.update([u, *node.tolist()])
    key = found.column("key")[0].as_py()
    return pa.table({"key": [key] * len(nodes), "node": list(nodes)}, _MET)


def _exact_links(found: pa.Table) -> pa.Table:
    """u, v: exactly confirmed links of a tile of full sets, none between components that other links of the tile join."""
    minor = _column(found, "minor", bool)
    every = found.filter(pa.array(~minor))
    sets = {int(n): np.frombuffer(raw, np.uint64) for t in (every, found.filter(pa.array(minor))) for n, raw in zip(t.column("node").to_pylist(), t.column("set").to_pylist(), strict=True)}
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = c = root.get(root[c], root[c])
        return c

    us, vs = [], []
    for u, cu, node, comp, differ in _candidates(found, True):
        a = sets[u]
        for k in np.argsort(differ, kind="stable"):
            x, y = find(cu), find(int(comp[k]))
            if x == y:
                continue
            b = sets[int(node[k])]
            short, long = (a, b) if len(a) < len(b) else (b, a)
            at = np.searchsorted(long, short)
            at[at == len(long)] = 0
            common = int(np.count_nonzero(long[at] == short))
            if 100 * common >= PERCENT * (len(a) + len(b) - common):
                root[x] = y
                us.append(u)
                vs.append(int(node[k]))
    return pa.table({"u": us, "v": vs}, _LINKS)


def _mixed(multi: DataFrame, labels: DataFrame) -> DataFrame:
    """The bucket rows (key, band, node, n, component) of buckets with several components, with the bucket's main one and its tiles."""
    labelled = multi.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "band", "node", "n", F.coalesce("component", "node").alias("component"))
    labelled = save(labelled, "bucket-components")
    counts = labelled.groupBy("key", "component").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("n_components"), F.sum("k").alias("k"), F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("k_main")).where("n_components > 1")
    mixed = save(mixed.select("key", "main", F.ceil((F.col("k") - F.col("k_main")) / TILE).cast("int").alias("tiles"), F.ceil(F.col("k") / SLICE).cast("int").alias("slices")), "mixed-buckets")
    rows = save(labelled.join(bounded(mixed), "key"), "mixed-rows")
    discard(multi.sparkSession, labelled, mixed)
    return rows


def _long_signatures(docs: DataFrame, classes: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """node, bands, long of the classes in the mixed buckets."""
    with scratch(docs.sparkSession) as made:
        long = _of_classes(docs, rows.select("node").distinct(), classes, long_bits, "long")
        return made.keep(save(long.join(reps.select("node", "bands"), "node").dropDuplicates(["node"]), "long-signatures"))


def _tiles(rows: DataFrame, both: DataFrame) -> DataFrame:
    """The rows of mixed buckets with their long signatures, dealt to key, tile and part."""
    # Buckets are made by these keys: only an equal key, not a likeness of minima, says that a pair meets in an earlier band.
    ends = rows.join(both, "node").withColumn("earlier", F.slice("bands", F.lit(1), F.col("band"))).drop("bands")
    tile = F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("slices")).cast("int")
    # A class outside the main component stands in its tile opposite every slice; every class stands in its slice opposite every tile.
    as_minor = ends.where(F.col("component") != F.col("main")).withColumns({"tile": tile, "part": F.explode(F.sequence(F.lit(0), F.col("slices") - 1)), "minor": F.lit(True)})
    as_any = ends.withColumns({"tile": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), "part": part, "minor": F.lit(False)})
    return as_minor.unionByName(as_any).drop("main", "tiles", "slices")


def _named(rows: DataFrame, both: DataFrame) -> DataFrame:
    """u, v: one pair at most for each class outside its bucket's main component; written."""
    found = _tiles(rows, both).groupBy("key", "tile", "part").applyInArrow(_partners, "u bigint, unclear int, v bigint")
    best = found.groupBy("u").agg(F.min(F.struct("unclear", "v")).alias("best"))
    return save(best.select(F.least("u", "best.v").alias("u"), F.greatest("u", "best.v").alias("v")).distinct(), "named-pairs")


def _rest(docs: DataFrame, classes: DataFrame, rows: DataFrame, both: DataFrame) -> DataFrame:
    """u, v: confirmed links between the components that are still apart; written."""
    with scratch(docs.sparkSession) as made:
        met = save(_tiles(rows, both).groupBy("key", "tile", "part").applyInArrow(_met, "key bigint, node bigint").distinct(), "met")
        sets = save(_of_classes(docs, met.select("node").distinct(), classes, lambda found: [s.tobytes() for s in found], "set").dropDuplicates(["node"]), "met-sets")
        few = rows.drop("tiles", "slices").join(met, ["key", "node"], "left_semi")
        minor = F.col("component") != F.col("main")
        size = few.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(minor, F.col("n"))) / SET_TILE)).cast("int").alias("tiles"), F.ceil(F.sum("n") / SET_SLICE).cast("int").alias("slices"))
        size = save(size, "met-sizes")
        found = _tiles(few.join(bounded(size), "key"), both).join(sets, "node").groupBy("key", "tile", "part").applyInArrow(_exact_links, "u bigint, v bigint")
        return made.keep(save(found.distinct(), "rest-links"))


def links(docs: DataFrame, sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, component over classes, from confirmed links."""
    spark = docs.sparkSession
    with scratch(spark) as made:
        reps = sigs.join(classes, "class").where(F.col("doc_id") == F.col("rep")).select("node", "n", "bands").dropDuplicates(["node"])
        reps = save(reps, "class-signatures")
        entries = reps.select(F.posexplode("bands").alias("band", "key"), "node", "n")
        shared = entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("k")).where("k > 1").select("key", "hub")
        multi = save(entries.join(shared, "key"), "buckets")
        stars = multi.where(F.col("node") != F.col("hub.node")).where(_sizes_fit(F.col("n"), F.col("hub.n")))
        stars = save(stars.select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct(), "stars")
        confirmed = confirm(docs, stars, classes)
        labels = save(components(confirmed), "components")
        rows = _mixed(multi.select("key", "band", "node", "n"), labels)
        both = _long_signatures(docs, classes, rows, reps)
        discard(spark, multi, stars, reps)
        named = _named(rows, both)
        if not named.isEmpty():
            confirmed = save(confirmed.unionByName(confirm(docs, named, classes)), "confirmed")
            labels = save(components(confirmed), "components")
            before, rows = rows, _mixed(rows.select("key", "band", "node", "n"), labels)
            discard(spark, before)
        rest = _rest(docs, classes, rows, both)
        if not rest.isEmpty():
            labels = save(components(confirmed.unionByName(rest)), "components")
        return made.keep(labels)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    sigs = save(signatures(docs), "signatures")
    classes = save(sigs.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "classes")
    first = F.row_number().over(Window.partitionBy("rep").orderBy("class")) == 1
    nodes = save(classes.withColumn("node", F.when(first, F.col("rep")).otherwise(F.lit(1 << 62) + F.monotonically_increasing_id())), "nodes")
    members = save(sigs.select("doc_id", "n", "class").join(nodes, "class", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "members")
    labels = links(docs, sigs, nodes)
    discard(spark, sigs, classes, nodes)
    # Different texts under one doc_id are one document: their components are linked too.
    several = members.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v")
    several = save(members.select("doc_id", "node").join(several.select("doc_id", "u"), "doc_id").select("u", F.col("node").alias("v")).where("u <> v").distinct(), "one-document")
    if not several.isEmpty():
        labels = save(components(several.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")
    discard(spark, several)
    component = F.coalesce("component", "node", "doc_id")
    joined = members.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates (that of the least doc_id), with exactly the columns of docs."""
    with scratch(docs.sparkSession) as made:
        found = save(near_duplicates(docs), "near-duplicates")
        dropped = made.keep(save(found.where("NOT kept").select(F.col("doc_id").alias("of")).distinct(), "dropped"))
        again = made.keep(save(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("of")), "repeated"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("words"))
    kept = packed.join(bounded(dropped), F.col("id") == F.col("of"), "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    one = Window.partitionBy("id").orderBy(F.length("words").desc(), "words")
    first = kept.join(bounded(again), F.col("id") == F.col("of"), "left_semi").withColumn("place", F.row_number().over(one)).where("place = 1")
    return kept.join(bounded(again), F.col("id") == F.col("of"), "left_anti").select("row.*").union(first.select("row.*"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
