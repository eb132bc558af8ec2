"""Merchant names and similarities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merchant_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")


def merchant_or_description() -> Column:
    """The merchant, else the description before the first mark that occurs of ' - ', ' | ', ' @ ', ' # ' (tried in that order)."""
    d = F.trim("description")
    cut = F.when(d.contains(" - "), F.substring_index(d, " - ", 1)).when(d.contains(" | "), F.substring_index(d, " | ", 1)).when(d.contains(" @ "), F.substring_index(d, " @ ", 1)).when(d.contains(" # "), F.substring_index(d, " # ", 1)).otherwise(d)
    return F.when(F.trim(F.coalesce("merchant_name", F.lit(""))) != "", F.trim("merchant_name")).otherwise(F.trim(cut))


def normalized_merchant(c: Column) -> Column:
    """Upper case without payment-rail prefixes, company endings, store numbers and marks."""
    x = F.upper(F.trim(c))
    for pattern in (r"^(ACH|PPD|POS|WEB|DEBIT|PURCHASE)\s+", r"\.COM\b", r"\b(INC|LLC|CORP|LTD)\b\.?", r"#\s*\d+", r"\b\d{4,}\b", r"\*"):
        x = F.regexp_replace(x, pattern, " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def lengths_fit(a: Column, b: Column, share: float) -> Column:
    """The shorter text has at least this share of the longer one's length; a Levenshtein similarity of `share` needs that."""
    return F.least(F.length(a), F.length(b)) >= F.greatest(F.length(a), F.length(b)) * (share - 1e-9)


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(F.lower(a), r"\s+")), F.array_distinct(F.split(F.lower(b), r"\s+"))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def jaro_winkler(a: str, b: str) -> float:
    """Half of the characters that stand in another order count as transpositions, rounded down, as in DuckDB's jaro_winkler_similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [b[j] for j in range(len(b)) if used[j]]
    m = len(mine)
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


#: Pairs whose longer text has more characters are scored one by one; others in blocks of so many characters a side.
LONGEST, BLOCK = 128, 1 << 18


def _jaro_winkler_block(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler of pairs of texts that are not empty, a character of all pairs at a time."""
    n, la, lb = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    grid = lambda texts, width: np.array(texts, f"U{width}").view(np.uint32).reshape(n, width)
    x, y = grid(a, la.max()), grid(b, lb.max())
    reach, at = np.maximum(la, lb) // 2 - 1, np.arange(y.shape[1])
    mine, used, furthest = np.zeros(x.shape, bool), np.zeros(y.shape, bool), int(reach.max())
    inside = at < lb[:, None]
    for i in range(x.shape[1]):
        part = slice(max(0, i - furthest), i + furthest + 1)
        free = (y[:, part] == x[:, i, None]) & ~used[:, part] & inside[:, part] & (np.abs(at[part] - i) <= reach[:, None]) & (i < la)[:, None]
        if free.shape[1]:
            j = free.argmax(axis=1)
            hit = np.flatnonzero(free[np.arange(n), j])
            mine[hit, i] = used[hit, j[hit] + part.start] = True
    m = mine.sum(axis=1)
    swaps = np.bincount(np.nonzero(mine)[0], x[mine] != y[used], n) // 2
    jaro = np.where(m == 0, 0.0, (m / la + m / lb + (m - swaps) / np.maximum(m, 1)) / 3)
    k = min(4, x.shape[1], y.shape[1])
    begin = (x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(la, lb)[:, None])
    return np.where(jaro > 0.7, jaro + np.cumprod(begin, axis=1).sum(axis=1) * 0.1 * (1 - jaro), jaro)


def jaro_winkler_all(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler of each pair."""
    out, pairs = np.zeros(len(a)), sorted((max(len(x), len(y)), i) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y)
    out[[i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x == y]] = 1.0
    while pairs and pairs[-1][0] > LONGEST:
        _, i = pairs.pop()
        out[i] = jaro_winkler(a[i], b[i])
    for first in range(0, len(pairs), BLOCK // LONGEST):
        block = [i for _, i in pairs[first : first + BLOCK // LONGEST]]
        out[block] = _jaro_winkler_block([a[i] for i in block], [b[i] for i in block])
    return out


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_all([p or "" for p in x], [q or "" for q in y]))

    return similarity(a, b)
