import re
from collections import Counter

from ledgerlake.llm import quality

SCHEMA = "doc_id bigint, text string, n_words string, failures string, m string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {p + k for p, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def rows(texts):
    return [(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)]


TEXTS = [None, "", " \n\t", "a b a b a b a b", "one\ntwo\none\n \none", " x y \x1cz é#*$", "w" * 10000, "x y z " * 5000, " ".join(f"word{i}" for i in range(200))]


def test_measures_match_brute_force(spark):
    got = quality.ledger(spark.createDataFrame(rows(TEXTS), SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_policies_and_ablations_are_bit_arithmetic(spark):
    docs = spark.createDataFrame(rows([*TEXTS, TEXTS[-1]]), SCHEMA)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [8, 9]
    found = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(quality.ledger(docs), "base").collect()}
    few = {i for i, t in enumerate(TEXTS) if brute(t)[0] < 50}
    rep = {i for i, t in enumerate(TEXTS) if 100 * brute(t)[4] > 50 * brute(t)[0]}
    assert found == {"few_words": (len(few), len(few - rep)), "repeated_words": (len(rep), len(rep - few))}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality.filter_documents(none).collect() == [] and quality.ledger(none).collect() == []
    assert {r.n_failed for r in quality.ablations(quality.ledger(none)).collect()} == {0}


def test_filter_keeps_every_column_whatever_its_name(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "m", "r"), (2, "few", "m", "r"), (3, None, None, None)], "doc_id bigint, text string, __m string, row string")
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, "m", "r")]
