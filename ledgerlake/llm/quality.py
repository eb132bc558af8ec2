"""Operator 2, quality rules as a bitmask ledger.

Every rule is evaluated once per document; its measurements and one failure bit a rule are stored (the ledger).
A policy is a named, versioned bit mask: applying another version, or asking what one rule alone removes,
is bit arithmetic over the ledger and never looks at a text again.

Defined results: a null or empty text has no words, measures 0 throughout and fails `few_words`. Repeated rows get a
ledger row each. An empty table gives an empty ledger, and ablations with zeros. Very long texts are measured whole, one at a time; no
result depends on an order, so no ties occur. Other columns of the input, whatever
their names, are left aside by ledger() and kept by filter_documents().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import bound_batches, table, utf8

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Rule name -> failure condition over the measurements m; the position is the bit. Integer arithmetic only.
RULES: dict[str, Callable] = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > 3 * m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    "few_letters": lambda m: 2 * m["n_letter_words"] < m["n_words"],
    "shouting": lambda m: 10 * m["n_exclaimed"] > 5 * m["n_words"],
}

#: Policy versions: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_exclaimed")


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def _repeated(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window which occurs at least twice. ids: the words as small integers."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)
    triple = pair[:-1] * (int(ids.max()) + 1) + ids[2:]
    _, where, count = np.unique(triple, return_inverse=True, return_counts=True)
    hit = count[where] > 1
    word = np.zeros(n, bool)
    word[:-2] |= hit
    word[1:-1] |= hit
    word[2:] |= hit
    return int(word.sum())


def _measure(raw: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    chars = len(b"".join(words).decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    counts = np.bincount(ids, minlength=len(seen)) if words else np.zeros(0, np.int64)
    kinds = list(seen)
    letters = sum(int(c) for w, c in zip(kinds, counts, strict=True) if w[:1].isalpha() or w[0] > 127)
    exclaimed = sum(int(c) for w, c in zip(kinds, counts, strict=True) if w.endswith(b"!!"))
    return len(words), chars, sum(raw.count(c) for c in SYMBOLS.encode()), len(lines), len(lines) - len(set(lines)), _repeated(ids), letters, exclaimed


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in MEASURES]))
def measured(raw: pd.Series) -> pd.DataFrame:
    rows = [_measure(x or b"") for x in raw]
    return pd.DataFrame(rows, columns=list(MEASURES), dtype="int64")


def failure_bits(m: str) -> Column:
    """All rules as one integer of bits, over the struct column `m` of measurements."""
    bits = F.lit(0)
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(rule(F.col(m)), F.lit(1 << i)).otherwise(F.lit(0)))
    return bits.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, every measurement and `failures` (a bit for each rule) for each row of docs(doc_id, text); no shuffle."""
    return bound_batches(docs).select("doc_id", measured(utf8()).alias("m")).select("doc_id", "m.*", failure_bits("m").alias("failures"))


def passes(policy: str = "v1", failures: Column | None = None) -> Column:
    """Whether a ledger row passes a policy."""
    return (F.col("failures") if failures is None else failures).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it rejects, from the stored bits alone."""
    failed = F.col("failures").bitwiseAND(F.lit(mask(policy)))
    each = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.coalesce(F.sum((failed.bitwiseAND(F.lit(1 << i)) != 0).cast("long")), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum((failed == (1 << i)).cast("long")), F.lit(0)).alias("n_only"),
        )
        for i, rule in enumerate(RULES)
        if rule in POLICIES[policy]
    ]
    return book.agg(F.array(*each).alias("rules")).select(F.inline("rules"))


def filter_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that pass the policy, with exactly their own columns."""
    return bound_batches(docs).select(F.struct("*").alias("row"), measured(utf8()).alias("m")).where(passes(policy, failure_bits("m"))).select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    base = F.col("failures").bitwiseAND(F.lit(mask("base"))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes("v1")).alias("kept"), "n_lines", "failures")


OP2_SQL = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(words) AS a, unnest(range(1, len(words) + 1)) AS p FROM w),
tri AS (SELECT doc_id, p, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM pos WINDOW s AS (PARTITION BY doc_id ORDER BY p)),
hit AS (SELECT doc_id, p FROM tri WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM hit) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
             CAST(len(list_filter(words, lambda x: regexp_matches(x, '^[A-Za-z]') OR ord(x) > 127)) AS BIGINT) AS n_letter_words,
             CAST(len(list_filter(words, lambda x: x LIKE '%!!')) AS BIGINT) AS n_exclaimed
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
      + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_letter_words < n_words THEN 32 ELSE 0 END)
      + (CASE WHEN 10 * n_exclaimed > 5 * n_words THEN 64 ELSE 0 END) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures & 15 = 0 AS kept, n_lines,
       CAST(failures AS BIGINT) AS failures FROM f
"""
