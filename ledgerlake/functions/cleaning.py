"""Merchant texts without payment noise, their words' stems and synonyms, and blended similarities (rows F05, F06, F09, F10, F42)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.text import jaro_winkler, jaro_winkler_all

#: processors' prefixes, payment rails, stop words, and synonyms of a canonical word.
NOISE_PREFIXES = ("sq*", "tst*", "pp*", "paypal *", "paypal*", "sp *", "sp*", "venmo *", "venmo*", "cash app*", "cashapp*", "square *", "square*", "stripe *", "stripe*", "goog*", "google *", "apl*", "apple.com")
RAILS = ("pos debit", "pos credit", "debit card purchase", "debit purchase", "card purchase", "ach debit", "ach credit", "direct dep", "direct deposit", "online transfer", "electronic payment", "bill pay", "billpay", "recurring payment", "mobile deposit", "web pmt", "web payment", "preauthorized", "preauth")
STOP_WORDS = ("the", "a", "an", "of", "at", "in", "on", "for", "to", "from", "and", "or", "with", "by", "via", "inc", "llc", "corp", "ltd", "co")
SYNONYMS = {
    "restaurant": ("eatery", "cafe", "diner", "bistro", "brasserie", "kitchen", "grill", "taverna"),
    "grocery": ("grocer", "market", "supermarket", "hypermarket", "bodega", "foodmart"),
    "pharmacy": ("drugstore", "apothecary", "chemist"),
    "fuel": ("gas", "petrol", "gasoline", "diesel"),
    "transport": ("transportation", "transit", "commute", "rideshare"),
    "subscription": ("membership", "recurring"),
    "utility": ("utilities", "internet", "broadband", "electric", "electricity", "water", "sewer", "trash", "garbage"),
    "healthcare": ("medical", "health", "clinic", "hospital", "doctor", "physician", "dental", "dentist"),
    "entertainment": ("cinema", "movies", "theater", "theatre", "concert", "streaming"),
    "salary": ("payroll", "wages", "compensation", "direct"),
    "transfer": ("xfer", "wire", "zelle", "venmo", "cashapp", "paypal"),
    "insurance": ("premium", "policy", "underwriting"),
    "education": ("tuition", "school", "university", "college", "course"),
}
STATES = "al|ak|az|ar|ca|co|ct|de|fl|ga|hi|id|il|in|ia|ks|ky|la|me|md|ma|mi|mn|ms|mo|mt|ne|nv|nh|nj|nm|ny|nc|nd|oh|ok|or|pa|ri|sc|sd|tn|tx|ut|vt|va|wa|wv|wi|wy|dc"

#: Patterns with their replacements, in order; longer prefixes stand before their beginnings.
_longest = lambda words: "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w)))
CLEANING = (
    (rf"^(?:(?:{_longest(NOISE_PREFIXES)})\s*)+", ""),
    (rf"^(?:(?:{_longest(RAILS)})\s+)+", ""),
    (rf" (?:{_longest(RAILS)}) ", " "),
    (r"#\s*\d+", " "),
    (r"\b\d{4,}\b", " "),
    (r"\b\d{5}(-\d{4})?\b", " "),
    (rf"\b({STATES})\b", " "),
    (r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", " "),
    (r"\s+", " "),
)


def clean_merchant(c: Column) -> Column:
    """Lower case without processors' prefixes, payment rails, store and phone numbers, long numbers and states. Null gives an empty text."""
    out = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    for pattern, new in CLEANING:
        out = F.trim(F.regexp_replace(out, pattern, new))
    return out


#: Endings with the least length of a word that loses them, what is cut and what is put; the first that fits counts.
ENDINGS = (("ies", 5, 3, "y"), ("ing", 6, 3, ""), ("ers", 6, 2, ""), ("es", 5, 2, ""), ("ed", 5, 2, ""), ("er", 5, 2, ""))


def stem(c: Column) -> Column:
    """A light stem; words of three letters or fewer stay."""
    n = F.length(c)
    out = F.when(n <= 3, c)
    for ending, least, cut, new in ENDINGS:
        out = out.when(F.endswith(c, F.lit(ending)) & (n >= least), F.concat(F.substring(c, F.lit(1), n - cut), F.lit(new)))
    return out.when(F.endswith(c, F.lit("s")) & ~F.endswith(c, F.lit("ss")), F.substring(c, F.lit(1), n - 1)).otherwise(c)


def expanded_words(text: Column) -> Column:
    """A text's words without stop words, with their stems and the canonical words of both; sorted, each once."""
    canonical = F.create_map(*[F.lit(x) for head, words in SYNONYMS.items() for w in (head, *words) for x in (w, head)])
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    stems = F.transform(words, stem)
    both = F.concat(words, stems)
    return F.sort_array(F.array_distinct(F.concat(both, F.filter(F.transform(both, lambda w: canonical[w]), lambda w: w.isNotNull()))))


def pattern_key(merchant: Column, description: Column) -> Column:
    """The merchant in lower case, else the description without numbers, 30 characters at most."""
    short = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(description)), r"\b\d+\b", ""), r"\s+", " "))
    return F.when(F.trim(F.coalesce(merchant, F.lit(""))) != "", F.lower(F.trim(merchant))).when(F.trim(F.coalesce(description, F.lit(""))) != "", F.substring(short, 1, 30))


def lookup(table: dict[str, float], key: Column) -> Column:
    """table[key], else the value of 'default', else 1."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.coalesce(key, F.lit(""))], F.lit(table.get("default", 1.0)))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def boosted_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words, and up to 0.2 more for long shared words (a twentieth of their mean length)."""
    x, y = words_of(a), words_of(b)
    both, every = F.array_intersect(x, y), F.array_union(x, y)
    mean = F.aggregate(both, F.lit(0.0), lambda s, w: s + F.length(w)) / F.size(both)
    boost = F.when(F.size(both) > 0, F.least(F.lit(0.2), mean / 20)).otherwise(0.0)
    return F.when(F.size(every) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(both) / F.size(every) + boost))


def contained(query: Column, candidate: Column) -> Column:
    """How far a candidate lies in a query: whole 0.95 and more; by half of its words or more up to 0.8, by fewer up to 0.3; the query in
    the candidate 0.90 and more. A word of five letters or more may also lie in the query between other characters than letters and digits."""
    asked, words = F.split(query, r"\s+"), F.filter(F.split(candidate, r"\s+"), lambda w: w != "")
    padded = F.concat(F.lit(" "), F.regexp_replace(query, "[^a-z0-9]+", " "), F.lit(" "))
    hit = F.size(F.filter(words, lambda w: F.array_contains(asked, w) | ((F.length(w) >= 5) & padded.contains(F.concat(F.lit(" "), w, F.lit(" "))))))
    share = hit / F.size(words)
    whole, back = F.least(F.lit(1.0), 0.95 + F.length(candidate) / F.length(query) * 0.05), F.least(F.lit(1.0), 0.9 + F.length(query) / F.length(candidate) * 0.1)
    none = (query == "") | (candidate == "")
    return F.when(none, 0.0).when(query.contains(candidate), whole).when(hit > 0, F.when(share >= 0.5, share * 0.8).otherwise(share * 0.3)).when(candidate.contains(query), back).otherwise(0.0)


@lru_cache(1 << 16)
def _word_similarity(a: str, b: str) -> float:
    """Pairs of words repeat much more than pairs of names."""
    return jaro_winkler(a, b)


def _token_similarity(a: str, b: str) -> float:
    """Shared words, where words from 0.7 on by Jaro-Winkler count as shared; their coverage weighs 0.6, their likeness 0.4."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    matched, likeness, n = set(), 0.0, 0
    for one in sorted(x):
        best, other = max(((_word_similarity(one, w), w) for w in sorted(y)), key=lambda m: m[0])
        if best >= 0.7:
            matched |= {one, other}
            likeness += best
            n += 1
    every = x | y
    if len(x) == len(y) and len(matched) == len(every) and n == len(x):
        return 1.0
    return min(1.0, len(matched) / len(every) * 0.6 + likeness / n * 0.4) if n else 0.0


@F.pandas_udf(T.StructType([T.StructField("whole", T.DoubleType()), T.StructField("words", T.DoubleType())]))
def _jaro_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    x, y = [p or "" for p in a], [q or "" for q in b]
    return pd.DataFrame({"whole": jaro_winkler_all(x, y), "words": [_token_similarity(p, q) for p, q in zip(x, y, strict=True)]})


def fuzzy_score(query: Column, candidate: Column) -> Column:
    """Jaro-Winkler, words, containment and Jaccard as 0.3, 0.35, 0.2 and 0.15; as 0.2, 0.3, 0.3 and 0.2 where Jaro-Winkler is under 0.3.

    Meant for distinct pairs of cleaned names: two of the four are computed in Python.
    """
    jaro, inside, shared = _jaro_scores(query, candidate), contained(query, candidate), boosted_jaccard(query, candidate)
    blend = lambda w: w[0] * jaro["whole"] + w[1] * jaro["words"] + w[2] * inside + w[3] * shared
    return F.when(jaro["whole"] < 0.3, blend((0.2, 0.3, 0.3, 0.2))).otherwise(blend((0.3, 0.35, 0.2, 0.15)))


@lru_cache(1 << 16)
def _read(name: str) -> tuple:
    """What contained and boosted_jaccard need of a name; names stand in many pairs."""
    asked, low = re.split(r"\s+", name, flags=re.ASCII), re.split(r"\s+", name.lower(), flags=re.ASCII)
    return set(asked), [w for w in asked if w], f" {re.sub('[^a-z0-9]+', ' ', name)} ", {w for w in low if w}


def _inside_and_shared(query: str, candidate: str) -> tuple[float, float]:
    """contained and boosted_jaccard of one pair."""
    (asked, _, padded, x), (_, words, _, y) = _read(query), _read(candidate)
    both = x & y
    shared = min(1.0, len(both) / len(x | y) + (min(0.2, sum(map(len, both)) / len(both) / 20) if both else 0.0)) if x or y else 0.0
    if not query or not candidate:
        return 0.0, shared
    if candidate in query:
        return min(1.0, 0.95 + len(candidate) / len(query) * 0.05), shared
    hit = sum(w in asked or (len(w) >= 5 and f" {w} " in padded) for w in words)
    if hit:
        share = hit / len(words)
        return share * (0.8 if share >= 0.5 else 0.3), shared
    return min(1.0, 0.9 + len(query) / len(candidate) * 0.1) if query in candidate else 0.0, shared


def fuzzy_score_from(query: Column, candidate: Column, least: float) -> Column:
    """fuzzy_score, or null where it is below `least`: what is costly is left out of pairs that can't reach it whatever it gives."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out, pairs = np.full(len(a), np.nan), []
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            inside, shared = _inside_and_shared(x or "", y or "")
            if 0.65 + 0.2 * inside + 0.15 * shared >= least - 1e-6:
                pairs.append((i, x or "", y or "", inside, shared))
        whole = jaro_winkler_all([p[1] for p in pairs], [p[2] for p in pairs])
        for (i, x, y, inside, shared), jw in zip(pairs, whole.tolist(), strict=True):
            w = (0.2, 0.3, 0.3, 0.2) if jw < 0.3 else (0.3, 0.35, 0.2, 0.15)
            out[i] = w[0] * jw + w[1] * _token_similarity(x, y) + w[2] * inside + w[3] * shared
        return pd.Series(np.where(out >= least - 1e-6, out, np.nan)).astype(object).where(lambda s: s.notna(), None)

    # Else a filter on the score is pushed below the shuffle that deals the pairs, and the UDF runs in the few tasks that made them.
    return score.asNondeterministic()(query, candidate)
