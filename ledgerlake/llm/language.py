"""Operator 8, hierarchical language identification.

A text's language family is predicted first, then the language within the family. Both steps vote over one-versus-one
linear support vector machines. Features are the relative frequencies of hashed byte pairs and triples of the lower-cased letters,
of the whole text. The machines are fitted on a bounded sample of labelled rows (at most SAMPLE a language, chosen by a hash). Its
features (six bytes a bucket that occurs) are made once, before rows are dealt to the pairs that they teach; a class of a pair has at
most SAMPLE rows, a family's in equal parts from its languages. Each pair is a group, so pairs are fitted in parallel as Spark
tasks, and only the weights come to the driver (BUCKETS floats a pair of classes).

Families are given for the languages named below; any other language is a family of its own.

Defined results: a null text, or one without a letter, is `und` with score 0; rows without a language teach nothing; with no
labelled rows everything is `und`; with one language it is predicted with score 1; a null doc_id is not held out and teaches
nothing; repeated rows are predicted each; very long texts count with all their features; ties of votes go to the larger
margin, then by name. Only doc_id, text and lang are read, lang for fitting alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded, discard, map_batches, save, scratch, table, utf8

BUCKETS = 1 << 14
#: Labelled rows of a language that fitting may use at most.
SAMPLE = 1500
EPOCHS = 6
REGULAR = 1e-4
SEED = 11

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only {lang}")


#: Bytes as the features see them: lower-case ASCII, other letters' bytes as they are, everything else one blank.
_CLASS = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint32)


def codes(raw: bytes) -> np.ndarray:
    """Hashed byte pairs and triples of a whole text; runs of blanks count as one."""
    c = _CLASS[np.frombuffer(b" " + raw + b" ", np.uint8)]
    c = c[1:][(c[1:] != 32) | (c[:-1] != 32)] if len(c) > 1 else c
    if len(c) < 2:
        return np.zeros(0, np.uint32)
    pair = c[:-1] * np.uint32(256) + c[1:]
    triple = pair[:-1] * np.uint32(256) + c[2:]
    return np.concatenate([(pair * np.uint32(2654435761)) >> np.uint32(18), (triple * np.uint32(2246822519) + np.uint32(97)) >> np.uint32(18)])


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): square roots of relative frequencies, so the vector has length one."""
    found, count = np.unique(codes(raw), return_counts=True)
    return found, np.sqrt(count / max(1, count.sum()))


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, epochs: int = EPOCHS, regular: float = REGULAR, seed: int = SEED) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine: averaged stochastic subgradient steps on the hinge."""
    rng = np.random.default_rng(seed)
    w, total, step = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 0
    scale = 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            step += 1
            at, x = rows[i]
            rate = 1.0 / (regular * (step + 1000))
            margin = signs[i] * scale * (w[at] @ x + w[-1])
            scale *= 1 - rate * regular
            if margin < 1:
                w[at] += rate * signs[i] / scale * x
                w[-1] += rate * signs[i] / scale * 0.1
        total += w * scale
    return total / epochs


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, place, raw: at most `sample` rows a language, those of the least hashes, never of held-out documents.

    Each language's hash bound comes from its row count, so only about `sample` rows a language are ordered.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40)).alias("h"), utf8().alias("raw"))
    bound = known.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("of"), F.least(F.lit(1.0), 1.2 * sample / F.col("n") + 100 / F.col("n")).alias("share"))
    # A row a language: broadcast, so that no text is shuffled but the sample's.
    near = known.join(bounded(save(bound, "language-shares"), 100_000), F.col("lang") == F.col("of")).where(F.col("h") < F.col("share") * float(1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "raw"))
    return near.withColumn("place", rank).where(F.col("place") <= sample).select("lang", "place", "raw")


def sampled_features(rows: DataFrame) -> DataFrame:
    """lang, place, buckets (16-bit numbers), values (32-bit floats) of each row of the sample."""

    def start():
        def step(batch):
            found = [features(raw.as_py()) for raw in batch.column("raw")]
            return {"lang": batch.column("lang"), "place": batch.column("place"), "buckets": [at.astype("<u2").tobytes() for at, _ in found], "values": [x.astype("<f4").tobytes() for _, x in found]}

        return step

    return map_batches(rows, start, "lang string, place int, buckets binary, values binary")


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The fitted machines: {'langs': [...], (class, class): weights}. Classes are families, and languages of one family."""
    with scratch(docs.sparkSession) as made:
        rows = made.keep(save(sampled_features(training_rows(docs, sample)), "language-sample"))
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    fams = sorted({family(x) for x in langs})
    pairs = [("family", a, b) for a, b in combinations(fams, 2)] + [("lang", a, b) for f in fams for a, b in combinations([x for x in langs if family(x) == f], 2)]
    if not pairs:
        discard(docs.sparkSession, rows)
        return {"langs": langs, "machines": {}}
    sides = []
    for k, (level, a, b) in enumerate(pairs):
        for side, sign in ((a, 1), (b, -1)):
            members = [x for x in langs if (family(x) if level == "family" else x) == side]
            sides += [(x, k, sign, -(-sample // len(members))) for x in members]
    listed = F.broadcast(rows.sparkSession.createDataFrame(sides, "of string, pair int, sign int, most int"))  # a row a pair and language
    each = rows.join(listed, (F.col("lang") == F.col("of")) & (F.col("place") <= F.col("most"))).select("pair", "sign", "lang", "place", "buckets", "values")

    def machine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["sign", "lang", "place"])
        vectors = [(np.frombuffer(at, "<u2"), np.frombuffer(x, "<f4")) for at, x in zip(group.buckets, group["values"], strict=True)]
        w = fit_svm(vectors, group.sign.to_numpy())
        return pd.DataFrame({"pair": [int(group.pair.iloc[0])], "w": [w.astype("<f4").tobytes()]})

    fitted = each.groupBy("pair").applyInPandas(machine, "pair int, w binary").collect()
    discard(docs.sparkSession, rows)
    return {"langs": langs, "machines": {pairs[r.pair]: np.frombuffer(bytes(r.w), "<f4") for r in fitted}}


def _vote(level: str, classes: list[str], margins: dict) -> tuple[str, float]:
    """The class with the most won pairs (ties: the larger summed margin, then by name), and how sure its closest pair is."""
    if len(classes) == 1:
        return classes[0], 1.0
    won = {c: [0, 0.0] for c in classes}
    for a, b in combinations(classes, 2):
        m = margins[level, a, b]
        won[a if m >= 0 else b][0] += 1
        won[a][1] += m
        won[b][1] -= m
    best = max(sorted(classes), key=lambda c: tuple(won[c]))
    closest = min(m if best == a else -m for (l, a, b), m in margins.items() if l == level and best in (a, b))
    return best, float(1 / (1 + np.exp(-4 * closest)))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs, from its whole text."""
    langs, machines = model["langs"], model["machines"]
    shared = docs.sparkSession.sparkContext.broadcast((list(machines), np.array(list(machines.values())) if machines else np.zeros((0, BUCKETS + 1), "f4")))
    fams = sorted({family(x) for x in langs})
    members = {f: [x for x in langs if family(x) == f] for f in fams}
    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw"), letter.alias("letter"))

    def start():
        keys, weights = shared.value
        bias = weights[:, -1]

        def one(raw: bytes) -> tuple[str, float]:
            at, x = features(raw)
            margins = dict(zip(keys, (weights[:, at] @ x + bias).tolist(), strict=True))
            fam, sure = _vote("family", fams, margins)
            lang, surer = _vote("lang", members[fam], margins)
            return lang, min(sure, surer)

        def step(batch):
            got = [one(raw.as_py()) if has.as_py() and langs else ("und", 0.0) for raw, has in zip(batch.column("raw"), batch.column("letter"), strict=True)]
            return {"doc_id": batch.column("doc_id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return step

    return map_batches(slim, start, "doc_id bigint, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
