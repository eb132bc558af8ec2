"""Operator 1, edit-aware token counts.

A document's text falls into pre-tokens (the tokenizer's own split), and runs of PER_LEAF pre-tokens are the leaves of a
segment tree. Every node holds the characters and the tokens below it. An edit finds its leaf by descending the character
sums, splits again only from a little before the edit to the first old leaf boundary behind it at which the new split
falls into step with the old one, encodes those pre-tokens, and updates the sums on the paths to the root. The new pre-tokens fill leaves of
PER_LEAF again; where they need more leaves than they replace, the tree is laid out anew over all leaves' sums, without encoding. The count of
the edited document is the root; nothing else is encoded again.

The tokenizer's pre-tokens are encoded independently of each other, so counts by pre-token are exact, and a per-task memo
holds those of frequent pre-tokens.

Defined results: a null or empty text has 0 tokens; edits are applied in order, each to the text that the former left; starts
and ends beyond the text are cut to it, null replacements are empty; a document without edits keeps its tree; repeated rows are
counted each; edits of unknown documents are dropped; an empty table gives no rows; very long texts get
deeper trees, of one document at a time; edits at one place keep their order, so no ties occur. Only the named columns are read.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import Bounded, map_batches, table

TOKENIZER = "byte_bpe_50k.tiktoken"
PER_LEAF = 32
#: Characters before an edit from which the split starts anew at the latest: a pre-token's end depends on two characters behind it.
CONTEXT = 3


class Counter:
    """Splits a text into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.count = Bounded(lambda piece: len(encoding.encode_ordinary(piece)), 200_000)

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each run of PER_LEAF pre-tokens."""
        pieces = self.split.findall(text)
        count = self.count
        chars, tokens = [], []
        for i in range(0, len(pieces), PER_LEAF):
            run = pieces[i : i + PER_LEAF]
            chars.append(len("".join(run)))
            tokens.append(sum([count[p] for p in run]))
        return chars, tokens


class Tree:
    """Segment tree in an array: node 1 is the root, node k has the children 2k and 2k+1, the leaves are the last half."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.lay_out(chars, tokens)

    def lay_out(self, chars, tokens) -> None:
        self.half = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.half, 2), np.int64)
        self.sums[self.half : self.half + len(chars), 0] = chars
        self.sums[self.half : self.half + len(chars), 1] = tokens
        self.used, k = len(chars), self.half
        while k > 1:
            self.sums[k // 2 : k] = self.sums[k : 2 * k : 2] + self.sums[k + 1 : 2 * k : 2]
            k //= 2

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character; the last leaf for the text's end."""
        k, begin = 1, 0
        while k < self.half:
            k *= 2
            if char >= begin + self.sums[k, 0] and self.sums[k + 1, 0]:
                begin += int(self.sums[k, 0])
                k += 1
        return k - self.half, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.half
        change = np.array([chars, tokens]) - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2


def apply_edit(counter: Counter, tree: Tree, text: str, start: int, end: int, new: str) -> tuple[str, int]:
    """The edited text and how many pre-tokens were encoded for it; the tree is brought up to date."""
    start = min(max(0, start), len(text))
    end = min(max(start, end), len(text))
    edited = text[:start] + new + text[end:]
    shift = len(new) - (end - start)
    first, begin = tree.leaf_at(max(0, start - CONTEXT))
    leaf, boundary = first, begin  # of the old text
    at, encoded = begin, 0
    made = [[0, 0]]  # characters and tokens of the new leaves
    for m in counter.split.finditer(edited, begin):
        while leaf < tree.used and (boundary < end or boundary + shift < at):
            boundary += int(tree.sums[tree.half + leaf, 0])
            leaf += 1
        if encoded and boundary >= end and boundary + shift == at and leaf > first:
            break
        if encoded and encoded % PER_LEAF == 0:
            made.append([0, 0])
        made[-1][0] += m.end() - m.start()
        made[-1][1] += counter.count[m[0]]
        encoded += 1
        at = m.end()
    else:
        leaf = tree.used
    if len(made) <= max(1, leaf - first):
        for k in range(max(1, leaf - first)):
            tree.put(first + k, *(made[k] if k < len(made) else (0, 0)))
        tree.used = max(tree.used, first + len(made) if made[0][0] else 0)
    else:
        old = tree.sums[tree.half : tree.half + tree.used]
        leaves = np.concatenate([old[:first], np.array(made), old[leaf:]])
        leaves = leaves[leaves[:, 0] > 0]
        tree.lay_out(leaves[:, 0], leaves[:, 1])
    return edited, encoded


def patch_counts(docs: DataFrame, edits: str = "edits", tokenizer_path: str | None = None) -> DataFrame:
    """docs(doc_id, text, edits: array of (start, end, replacement)) -> counts before and after, with the work it took.

    doc_id, n_tokens (before), n_tokens_after, n_chars_after, n_pretokens_encoded (for the edits), n_leaves. One pass.
    """
    path, pattern = tokenizer_path or tokenizer_file(), split_pattern()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(edits).cast("array<struct<start:bigint,end:bigint,replacement:string>>").alias("edits"))

    def start():
        counter = Counter(path, pattern)

        def step(batch):
            out = {k: [] for k in ("n_tokens", "n_tokens_after", "n_chars_after", "n_pretokens_encoded", "n_leaves")}
            for text, changes in zip(batch.column("text"), batch.column("edits"), strict=True):
                text, encoded = text.as_py(), 0
                tree = Tree(*counter.leaves(text))
                out["n_tokens"].append(tree.n_tokens)
                out["n_leaves"].append(tree.used)
                for e in changes.as_py() or ():
                    text, n = apply_edit(counter, tree, text, e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                    encoded += n
                out["n_tokens_after"].append(tree.n_tokens)
                out["n_chars_after"].append(tree.n_chars)
                out["n_pretokens_encoded"].append(encoded)
            return {"doc_id": batch.column("doc_id")} | out

        return step

    return map_batches(rows, start, "doc_id bigint, n_tokens bigint, n_tokens_after bigint, n_chars_after bigint, n_pretokens_encoded bigint, n_leaves bigint")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the edits of a table edits(doc_id, seq, start, end, replacement) as one array a document, in order of seq."""
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("e"))
    listed = each.select("doc_id", F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement"))).alias("edits"))
    return docs.select("doc_id", "text").join(listed, "doc_id", "left")


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets the same three edits: the character in the middle goes, a word comes in at a third, a line at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length("text").cast("long")

    def edit(start, end, new):
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("replacement"))

    edits = F.array(edit(F.floor(n / 2), F.floor(n / 2) + 1, ""), edit(F.floor(n / 3), F.floor(n / 3), " revised 2nd"), edit(n + 11, n + 11, "\nThe end."))
    return patch_counts(docs.withColumn("edits", F.when(n.isNotNull(), edits)))
