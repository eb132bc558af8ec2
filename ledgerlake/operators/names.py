"""Nearest names by a set-similarity join (row C08; for F07 to F10 and J05, J17 where all pairs would be asked for).

The blended score of two names is 0.3 of Jaro-Winkler, 0.35 of their words' likeness, 0.2 of containment and 0.15 of shared words (other
weights where Jaro-Winkler is low). From LOWEST on, the first two alone can't reach a threshold. So a pair that does has one of:

* a share of the known name's words that the threshold implies. The known name is indexed under its rarest words only: of n words of which
  some o must be shared, any o meet the n - o + 1 rarest (the prefix). A name asks under all its words.
* the known name whole inside the name. It is indexed under its rarest three letters, and a name asks under all its threes;
* the name whole inside the known name: the same with the sides changed.

What these find is first held against the most that containment and shared words let it score, which leaves out most pairs of one shared word;
the rest is scored exactly. No pair is left out, and none is made that shares nothing.

Defined results: null and blank names match nothing; equal names score highest; repeated names count once; ties go to the lesser known name.
Very long names have as many words and threes as they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.cleaning import fuzzy_score_from

#: Jaro-Winkler and words' likeness alone reach this at most.
LOWEST = 0.65
#: Names of more words are indexed under all of them.
COUNTED = 64


def _reachable(share: float) -> float:
    """The most that containment and shared words add where this share of the known name's words is shared."""
    return 0.2 * (0.8 if share >= 0.5 else 0.3) * share + 0.15 * min(1.0, share + 0.2)


def required(n: int, least: float) -> int:
    """Of n words of the known name, how many a pair at the threshold shares at least (more than n: containment only)."""
    return next((k for k in range(1, n + 1) if LOWEST + _reachable(k / n) >= least - 1e-9), n + 1)


def _prefix(words: Column, least: float) -> Column:
    """The beginning of a list of words, rarest first, that any pair at the threshold meets."""
    table = F.array(*[F.lit(n - required(n, least) + 1) for n in range(COUNTED + 1)])
    n = F.size(words)
    return F.slice(words, F.lit(1), F.when(n <= COUNTED, F.get(table, n)).otherwise(n))


def _split(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda w: w != "")


def _grams(name: Column) -> Column:
    """All threes of letters; a shorter name itself."""
    n = F.length(name)
    return F.when(n <= 3, F.array(name)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(name, i, F.lit(3)))))


def _short(name: Column) -> Column:
    """All ones and twos of letters, under which shorter names are asked for."""
    n = F.length(name)
    part = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(part(1), part(2)))


def _distinct(frame: DataFrame, column: str, name: str) -> DataFrame:
    c = F.col(column)
    return frame.select(c.alias(name)).where(F.trim(F.coalesce(c, F.lit(""))) != "").distinct()


def _ranked(frame: DataFrame, name: str, parts: Column, counts: DataFrame) -> DataFrame:
    """name and its parts (with repeats) rarest first; parts that are counted nowhere come first."""
    each = frame.select(name, F.explode(parts).alias("part")).join(counts, "part", "left")
    return each.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part"))), lambda s: s["part"]).alias("parts"))


def candidates(names: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """name, known: every pair of names(name) and known(known) that may score `least` or more, each once."""
    if least <= LOWEST:
        raise ValueError(f"the least score must be above {LOWEST}")
    k, q = F.col("known"), F.col("name")
    word_counts = known.select("known", F.explode(F.array_distinct(_split(k))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    with_repeats = _ranked(known, "known", _split(k), word_counts).select("known", F.explode(_prefix(F.col("parts"), least)).alias("part"))
    once = _ranked(known, "known", F.array_distinct(_split(k)), word_counts).select("known", F.explode(_prefix(F.col("parts"), least)).alias("part"))
    asked = names.select("name", F.explode(F.array_distinct(F.concat(_split(q), F.filter(F.split(q, "[^a-z0-9]+"), lambda w: F.length(w) >= 5)))).alias("part"))
    by_word = asked.join(with_repeats.unionByName(once).distinct(), "part").select("name", "known")

    gram_counts = known.select(F.explode(_grams(k)).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    rarest = lambda frame, name: _ranked(frame, name, _grams(F.col(name)), gram_counts).select(name, F.get("parts", F.lit(0)).alias("part"))
    every = lambda frame, name: frame.select(name, F.explode(F.array_distinct(F.concat(_grams(F.col(name)), _short(F.col(name))))).alias("part"))
    inside = every(names, "name").join(rarest(known, "known"), "part").where(q.contains(k)).select("name", "known")
    around = rarest(names, "name").join(every(known, "known"), "part").where(k.contains(q)).select("name", "known")
    # Pairs are short but costly to score: a number of tasks that is given is not coalesced by their bytes.
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return by_word.unionByName(inside).unionByName(around).repartition(tasks, "name", "known").distinct()


def near_names(names: DataFrame, known: DataFrame, least: float = 0.75, name: str = "name", known_name: str = "known") -> DataFrame:
    """name, known, score (six places): all pairs of cleaned names that score `least` or more, each once."""
    pairs = candidates(_distinct(names, name, "name"), _distinct(known, known_name, "known"), least)
    return pairs.select("name", "known", F.round(fuzzy_score_from(F.col("name"), F.col("known"), least), 6).alias("score")).where(F.col("score") >= least)


def nearest_names(names: DataFrame, known: DataFrame, least: float = 0.75, name: str = "name", known_name: str = "known") -> DataFrame:
    """name, known, score of the best known name of each name that has one."""
    found = near_names(names, known, least, name, known_name)
    best = found.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("far"), "known")).alias("best"))
    return best.select("name", "best.known", (-F.col("best.far")).alias("score"))
