"""Operator 9, mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target: its weight's share of the whole, at most `most` times its size, what is cut off going to the
other sources by weight until none is above. A source is taken whole as many times as its target holds it (complete epochs);
the rest of the target is a weighted sample without replacement: each document draws the exponential key -ln(u) / quality,
and documents are taken in ascending order of the key while their sizes fit the budget.

No source is sorted as a whole: keys fall into BINS bins, sizes are summed for each source and bin (combined before the
shuffle), a prefix sum over a source's bins finds the bin where the budget ends, and only that bin's different documents are ordered
one by one. u is a hash of doc_id and text, so reruns agree.
The result for a source is a cut: documents before that (key, doc_id) get one more epoch than the others. Repeated rows draw one key;
where the budget ends among them, so many of them as fit are before the cut. They are numbered partition by partition, so one row
repeated in a third of all rows is in no task as a whole.

Defined results: a null text has size 0; null is a source of its own, after all others; documents of size 0 are taken
in complete epochs only (0 words); which of several equal rows get the epoch more is all the same; a source without words has
target 0; an empty table gives no rows; very long texts are measured whole, and none is cut. Columns beside doc_id, text and source are kept by mix(), and may have any names. Tables with
a row a source (some tens of bytes) are held by one task: tens of millions of sources are beyond this design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import BLANKS, bounded, save, scratch, table

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
BINS = 4096
SEED = "mix-1"
#: Characters that lower a document's quality weight, and the least weight.
SYMBOLS = "#*$%&|<>"
LEAST_QUALITY = 0.05


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight from LEAST_QUALITY to 1: the share of a text's characters that are no symbols."""
    clean = F.length(F.translate(text, SYMBOLS, "")) / F.length(text)
    return F.when(F.length(text) > 0, F.greatest(F.lit(LEAST_QUALITY), clean)).otherwise(LEAST_QUALITY)


def exponential_key(doc_id: Column, text: Column, seed: str) -> Column:
    """-ln(u) / quality; u in (0, 1) from 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), text))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / quality(text)


def _bin(key: Column) -> Column:
    return F.least(F.floor((1 - F.exp(-key)) * BINS), F.lit(BINS - 1))


def _drawn(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """Every row's doc_id, source, size and key, and `more`; no other names."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", "source", n_words(text).alias("size"), exponential_key(F.col("doc_id"), text, seed).alias("key"), *more)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> with target. One row a source; the water level is found by two prefix sums over the sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = (most * F.col("source_size")).cast("double")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap)
    rows = rows.withColumns({
        "left": F.lit(share_percent) * F.sum("source_size").over(everything) / F.lit(100.0) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "place": F.row_number().over(filling),
    })
    fits = F.col("left") / F.col("weights") * F.col("weight") <= F.col("cap")
    level = F.min_by(F.when(fits, F.col("left") / F.col("weights")), F.when(fits, F.col("place"))).over(everything)
    return rows.withColumn("level", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def cuts(drawn: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """of, cut for each source: its size, target, complete epochs, the bin and the last (key, doc_id) with rows that get one more, and
    how many of its `n_last` rows these are.

    drawn: doc_id, source, size, key.
    """
    rows = drawn.withColumn("bin", _bin(F.col("key")))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    known = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share_percent, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    known = known.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = (
        bins.withColumn("base", F.sum("bin_size").over(upto) - F.col("bin_size"))
        .join(known.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("bin_size") > F.col("rest")))
        .select("of", F.col("bin").alias("cross_bin"), "base", "rest")
    )
    # A row a source: broadcast, so that only the rows of the crossing bins are dealt out by source.
    crossing = bounded(save(crossing, "mix-crossing"))
    near = rows.join(crossing, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("cross_bin")))
    near = near.groupBy("source", "key", "doc_id", "size", "base", "rest").agg(F.count("*").alias("n_last"))  # repeated rows as one
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.col("size") * F.col("n_last")
    # The k-th copy from 0 is taken if that comes nearer to the target: 2 (before + k size) + size <= 2 rest.
    left = 2 * (F.col("rest") - F.col("before")) - F.col("size")
    fit = F.when(left < 0, 0).when(F.col("size") == 0, F.col("n_last")).otherwise(F.least(F.col("n_last"), F.floor(left / (2 * F.col("size"))) + 1))
    inside = near.withColumn("before", F.col("base") + F.sum(whole).over(order) - whole).withColumn("n_more", fit.cast("long")).where("n_more > 0")
    last = inside.groupBy("source").agg(F.max(F.struct("key", "doc_id", "n_more", "n_last")).alias("last")).select(F.col("source").alias("of_last"), "last")
    out = known.join(crossing.select("of", "cross_bin"), F.col("source").eqNullSafe(F.col("of")), "left").join(last, F.col("source").eqNullSafe(F.col("of_last")), "left")
    return out.select(F.col("source").alias("of"), F.struct("source_size", "target", "epochs", "cross_bin", F.struct("last.key", "last.doc_id").alias("last"), "last.n_more", "last.n_last").alias("cut"))


def _times(drawn: DataFrame, written_cuts: DataFrame) -> DataFrame:
    """Every row with its source's `cut` and `times`: how often the mix takes it."""
    joined = drawn.join(bounded(written_cuts), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    bin_of, at = _bin(F.col("key")), F.struct("key", "doc_id")
    in_bin = (bin_of == F.col("cut.cross_bin")) & F.col("cut.last.key").isNotNull()
    before = (bin_of < F.col("cut.cross_bin")) | (in_bin & (at < F.col("cut.last")))
    border = F.coalesce(in_bin & at.eqNullSafe(F.col("cut.last")), F.lit(False))
    plain = F.col("cut.epochs") + F.coalesce(before, F.lit(False)).cast("long")
    if written_cuts.where("cut.n_more < cut.n_last").isEmpty():
        return joined.withColumn("times", plain + border.cast("long"))
    copies = save(joined.where(border & (F.col("cut.n_more") < F.col("cut.n_last"))).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "mix-copies")
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = copies.groupBy("source", "part").agg(F.count("*").alias("n")).select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("source", "part").orderBy("at"))
    numbered = copies.join(ahead, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).withColumn("times", F.col("cut.epochs") + (place <= F.col("cut.n_more")).cast("long"))
    others = joined.where(~(border & F.coalesce(F.col("cut.n_more") < F.col("cut.n_last"), F.lit(False)))).withColumn("times", plain + border.cast("long"))
    return others.unionByName(numbered.select(*others.columns))


def mix_report(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, text, source)."""
    drawn = save(_drawn(docs, seed), "mix-drawn")
    with scratch(docs.sparkSession) as made:
        cut = made.keep(save(cuts(drawn, **how), "mix-cuts"))
    found = _times(drawn, cut)
    return found.select("doc_id", "size", "cut.source_size", "cut.target", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, with exactly their own columns."""
    with scratch(docs.sparkSession) as made:
        cut = made.keep(save(cuts(save(_drawn(docs, seed), "mix-drawn"), **how), "mix-cuts"))
    found = _times(_drawn(docs, seed, F.struct("*").alias("row")), cut)
    return found.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, CAST(length(translate(text, '#*$%&|<>', '')) AS DOUBLE) / length(text)) ELSE 0.05::DOUBLE END AS q,
             (CAST('0x' || substr(md5('mix-1|' || doc_id || '|' || text), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
c AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
f AS (SELECT *, CAST(150 * (SELECT sum(source_size) FROM c) AS DOUBLE) / 100.0::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest_words,
             (SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER b, 0) AS weights, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
      FROM c WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (SELECT arg_min(rest_words / weights, place) FROM f WHERE rest_words / weights * weight <= cap) AS level),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
o AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.q, d.doc_id) - d.size AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS taken FROM o
"""
