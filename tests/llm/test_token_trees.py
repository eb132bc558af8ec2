import base64
import random

import public_tokenizers as P
import tiktoken

from ledgerlake.llm import token_trees as T


def whole():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(T.TOKENIZER), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_edits_count_as_whole_encoding_does():
    rng = random.Random(5)
    counter, encoding = T.Counter(T.tokenizer_file(), P.PATTERN), whole()
    alphabet = ["word ", "it's ", " ", "\n", "  ", "12 ", "é", "!!", "\t\t", "don", "'", "t", "日本", "\r\n", " x", " ", "'ll "]
    for trial in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60, 900])))
        tree = T.Tree(*counter.leaves(text))
        assert tree.n_tokens == len(encoding.encode_ordinary(text))
        for _ in range(8):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 40, 700]))
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 50])))
            text, _ = T.apply_edit(counter, tree, text, a, b, new)
            assert (tree.n_tokens, tree.n_chars) == (len(encoding.encode_ordinary(text)), len(text)), trial


def test_only_the_touched_region_is_encoded():
    counter = T.Counter(T.tokenizer_file(), P.PATTERN)
    text = "some words here " * 5000
    tree = T.Tree(*counter.leaves(text))
    _, encoded = T.apply_edit(counter, tree, text, 40000, 40001, "x")
    assert 0 < encoded <= 4 * T.PER_LEAF


def test_edit_table_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "hello world", "e"), (1, "hello world", "e"), (2, None, "e"), (3, "", "e"), (None, "lost", "e")], "doc_id bigint, text string, n_tokens string")
    edits = spark.createDataFrame([(1, 2, 0, 5, "bye"), (1, 1, 11, 11, " again and again"), (2, 1, 5, 9, "new text"), (9, 1, 0, 0, "x"), (3, 1, -4, 2, None)], "doc_id bigint, seq int, start bigint, end bigint, replacement string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in T.patch_counts(T.with_edits(docs, edits)).collect())
    n = lambda s: len(whole().encode_ordinary(s))
    one = (1, n("hello world"), n("bye world again and again"), 25)
    assert got == [(0, n("lost"), n("lost"), 4), one, one, (2, 0, n("new text"), 8), (3, 0, 0, 0)]
    assert T.patch_counts(T.with_edits(docs.limit(0), edits)).collect() == []


def test_large_inserts_fill_leaves_of_the_usual_size():
    rng = random.Random(9)
    counter, encoding = T.Counter(T.tokenizer_file(), P.PATTERN), whole()
    text = "some words here " * 50
    tree = T.Tree(*counter.leaves(text))
    for k in range(40):
        a = rng.randint(0, len(text))
        text, _ = T.apply_edit(counter, tree, text, a, a, "inserted words and more " * rng.choice([1, 40, 400]))
        assert tree.n_tokens == len(encoding.encode_ordinary(text))
    _, encoded = T.apply_edit(counter, tree, text, len(text) // 2, len(text) // 2 + 1, "x")
    assert 0 < encoded <= 4 * T.PER_LEAF


def test_the_query_counts_what_its_three_edits_leave(spark, tmp_path):
    texts = ["", None, "a", "short text", "some words here, it's long.\n" * 300, "é日本 " * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    encoding = whole()
    for r in T.op1_token_counts(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        assert r.n_tokens == len(encoding.encode_ordinary(text))
        if texts[r.doc_id] is not None:
            n = len(text)
            text = text[: n // 2] + text[n // 2 + 1 :]
            text = text[: n // 3] + " revised 2nd" + text[n // 3 :]
            text = text[: n + 11] + "\nThe end." + text[n + 11 :]
        assert (r.n_tokens_after, r.n_chars_after) == (len(encoding.encode_ordinary(text)), len(text))
