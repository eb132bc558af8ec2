"""Ordered keyword steps over imported rows (row C11), and curated rules (C05, J15), by one multi-word automaton.

The steps are a file (`read_steps`). All their words go into one automaton, so a text is read once however many steps there are. A task keeps a
bounded memo of distinct texts. What depends on texts alone, the steps whose words hold, is found there, in order; what depends on the row
(amount, account, type) is decided by Spark expressions, which take the first step left. No shuffle, no join of rows with rules.

Defined results: null texts are empty; a row on which no step holds has a null step and the category `other`; a null amount is neither in, out
nor zero; texts are read whole. An empty list of steps gives `other` throughout.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STARTER = str(Path(__file__).parent.parent / "rules" / "import_steps.toml")
FIELDS = ("description", "merchant", "category", "channel")
#: Conditions on rows, a bit each.
NEEDS = ("in", "out", "zero", "investment", "card", "income")
#: Distinct texts that a task remembers; longer texts are not kept.
MEMO, MEMO_LENGTH = 100_000, 400
#: Words of one automaton (some hundred bytes each); more words are several passes.
AUTOMATON_WORDS = 200_000


class Words:
    """Finds which of many words occur in a text."""

    def __init__(self, words: Iterable[str]):
        import ahocorasick

        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for w in words if w))}
        self.automaton = ahocorasick.Automaton()
        for w, i in self.numbers.items():
            self.automaton.add_word(w, (i, len(w)))
        if self.numbers:
            self.automaton.make_automaton()

    def find(self, text: str) -> tuple[set[int], set[int]]:
        """Numbers of the words that occur, and of those that occur between other characters than letters and digits."""
        parts, whole = set(), set()
        for end, (i, length) in self.automaton.iter(text) if self.numbers and text else ():
            parts.add(i)
            before = end - length
            if (before < 0 or not text[before].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                whole.add(i)
        return parts, whole


def read_steps(path: str = STARTER) -> list[dict]:
    """The steps of a file, in order, checked."""
    with open(path, "rb") as f:
        steps = tomllib.load(f).get("step", [])
    for s in steps:
        unknown = set(s) - {"name", "category", "in", "words", "also", "without", "whole", "amount", "account", "type"}
        if unknown or not s.get("words") or not s.get("category") or set(s.get("in", [])) - set(FIELDS) or not set(_needs(s)) <= set(NEEDS):
            raise ValueError(f"not a step: {s}")
    return steps


def _needs(step: dict) -> list[str]:
    return [step[k] for k in ("amount", "account", "type") if k in step]


class StepList:
    """Steps compiled for texts: each step is asked for only where one of its words occurs."""

    def __init__(self, steps: list[dict]):
        self.words = Words(w.lower() for s in steps for part in ("words", "also", "without") for w in s.get(part, []))
        number = lambda part: [{self.words.numbers[w.lower()] for w in s.get(part, [])} for s in steps]
        self.any, self.also, self.without = number("words"), number("also"), number("without")
        self.whole = [bool(s.get("whole")) for s in steps]
        self.fields = [[FIELDS.index(f) for f in s.get("in", ["description", "merchant"])] for s in steps]
        self.of_word: dict[int, list[int]] = {}
        for k, words in enumerate(self.any):
            for w in words:
                self.of_word.setdefault(w, []).append(k)

    def holding(self, texts: tuple[str, ...]) -> list[int]:
        """Steps whose words hold in these texts (one of each of FIELDS), in order."""
        found = [self.words.find(t) for t in texts]
        asked = sorted({k for parts, _ in found for w in parts for k in self.of_word.get(w, ())})
        out = []
        for k in asked:
            seen = set().union(*(found[f][self.whole[k]] for f in self.fields[k]))
            if seen & self.any[k] and (not self.also[k] or seen & self.also[k]) and not seen & self.without[k]:
                out.append(k)
        return out


def _remembered(make, texts: Iterator[tuple], memo: dict) -> list:
    out = []
    for t in texts:
        value = memo.get(t)
        if value is None:
            value = make(t)
            if len(memo) >= MEMO:
                memo.clear()
            if sum(map(len, t)) <= MEMO_LENGTH:
                memo[t] = value
        out.append(value)
    return out


def decide(rows: DataFrame, steps: list[dict], description: Column, merchant: Column, category: Column, channel: Column, amount: Column, account: Column | None = None, kind: Column | None = None, least: str = "other") -> DataFrame:
    """rows with step (its name) and step_category: those of the first step that holds. account: its type; kind: the transaction's type."""
    if not steps:
        return rows.withColumn("step", F.lit(None).cast("string")).withColumn("step_category", F.lit(least))

    @F.pandas_udf("array<int>")
    def holding(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        compiled, memo = StepList(steps), {}
        for columns in batches:
            yield pd.Series(_remembered(compiled.holding, zip(*columns, strict=True), memo), dtype=object)

    text = [F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))) for c in (description, merchant, category, channel)]
    none, kinds = F.lit(None).cast("string"), {"investment": ("investment", "ira", "401k", "hsa", "529"), "card": ("credit", "card")}
    of = F.lower(none if account is None else account)
    is_kind = lambda k: F.coalesce(F.exists(F.array(*[F.lit(w) for w in kinds[k]]), lambda w: of.contains(w)), F.lit(False))
    has = {"in": amount > 0, "out": amount < 0, "zero": amount == 0, "investment": is_kind("investment"), "card": is_kind("card"), "income": F.lower(none if kind is None else kind) == "income"}
    bits = F.lit(0)
    for i, name in enumerate(NEEDS):
        bits = bits.bitwiseOR(F.when(F.coalesce(has[name], F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)))
    needs = F.array(*[F.lit(sum(1 << NEEDS.index(n) for n in _needs(s))) for s in steps])
    names, categories = (F.array(*[F.lit(s.get(part)) for s in steps]) for part in ("name", "category"))
    held = rows.withColumn("_holding", holding(*text)).withColumn("_bits", bits)
    first = F.get(F.filter("_holding", lambda k: F.get(needs, k).bitwiseAND(F.col("_bits")) == F.get(needs, k)), F.lit(0))
    out = held.withColumn("_first", first).withColumn("step", F.get(names, F.col("_first"))).withColumn("step_category", F.coalesce(F.get(categories, F.col("_first")), F.lit(least)))
    return out.drop("_holding", "_bits", "_first")


def _best_of(listed: list[tuple]):
    """For texts the first of the listed rules (keyword, category, level, length, priority, rule_id) whose keyword occurs."""

    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words(k for k, *_ in listed)
        first: dict[int, int] = {}
        for place, (k, *_) in enumerate(listed):
            first.setdefault(words.numbers[k], place)
        for series in batches:
            places = [min((first[i] for i in words.find(t or "")[0]), default=None) for t in series]
            rows = [(None,) * 5 if p is None else listed[p][1:] for p in places]
            yield pd.DataFrame(rows, columns=["category", "level", "length", "priority", "rule_id"]).astype({"level": "Int32", "length": "Int32", "priority": "Int32", "rule_id": "Int64"})

    return best


def best_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """text -> rule_category of the best rule for each distinct text of texts(text).

    rules: rule_id, keyword, rule_category, priority, source_level. The lowest source level counts, then the longest keyword, the highest
    priority, the least rule_id. Rules beyond AUTOMATON_WORDS are taken in several passes, whose best are compared.
    """
    ordered = rules.where("keyword IS NOT NULL AND keyword <> ''")
    n = ordered.count()
    found = []
    for part in range(max(1, -(-n // AUTOMATON_WORDS))):
        passes = -(-n // AUTOMATON_WORDS) or 1
        mine = ordered.where(F.pmod(F.xxhash64("rule_id"), F.lit(passes)) == part).collect()
        ranked = sorted(mine, key=lambda r: (r.source_level, -len(r.keyword), -r.priority, r.rule_id))
        listed = [(r.keyword, r.rule_category, r.source_level, len(r.keyword), r.priority, r.rule_id) for r in ranked]

        rule = F.pandas_udf(_best_of(listed), "category string, level int, length int, priority int, rule_id bigint")
        found.append(texts.select("text", rule("text").alias("rule")).where("rule.category IS NOT NULL"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    if len(found) > 1:
        r = F.col("rule")
        every = every.groupBy("text").agg(F.min_by("rule", F.struct(r["level"], -r["length"], -r["priority"], r["rule_id"])).alias("rule"))
    return every.select("text", F.col("rule.category").alias("rule_category"))
