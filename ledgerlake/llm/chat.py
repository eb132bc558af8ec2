"""Operator 7 [native], chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs, sorted by turn, adjacent turns of one role are merged into one block by
an array fold, and the blocks are concatenated:

    <turn:ROLE>text of a turn<next>text of the following turn of that role</turn>\\n

`&`, `<` and `>` inside roles and texts are escaped as entities, so no text can hold a control string, and unescaping gives
back exactly the text. Loss spans cover the assistant texts in the formatted string, nothing else.

Defined results: null texts are empty, null roles are empty roles, null turns sort first; equal turns are ordered by role, then
text; repeated rows are turns of their own; rows with a null conv_id form one conversation; an empty table gives no rows; very long texts are
formatted whole, a conversation is one row; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import table

OPEN, OPENED, NEXT, CLOSE = "<turn:", ">", "<next>", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """No `<` or `>` is left."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


_BLOCKS = "array<struct<role:string,texts:array<string>>>"
_SPANS = "array<struct<start:bigint,length:bigint>>"


def _merge(blocks: Column, turn: Column) -> Column:
    """One fold step: a turn joins the last block if its role is the same, and else begins a block."""
    last = F.get(blocks, F.size(blocks) - 1)
    joined = F.concat(
        F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))),
        F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))),
    )
    begun = F.concat(blocks, F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))))
    return F.when((F.size(blocks) > 0) & (last["role"] == turn["role"]), joined).otherwise(begun)


def _place(state: Column, block: Column) -> Column:
    """One fold step over blocks: state is (length so far, spans)."""
    first = state["at"] + F.length(block["role"]) + len(OPEN) + len(OPENED)
    lengths = F.transform(block["texts"], lambda t: F.length(t).cast("long"))
    placed = F.aggregate(
        lengths,
        F.struct(first.cast("long").alias("at"), state["spans"].alias("spans")),
        lambda s, n: F.struct((s["at"] + n + len(NEXT)).alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), n.alias("length")))).alias("spans")),
    )
    end = F.aggregate(lengths, first.cast("long") - len(NEXT), lambda a, n: a + n + len(NEXT)) + len(CLOSE)
    return F.struct(end.alias("at"), F.when(block["role"] == LOSS_ROLE, placed["spans"]).otherwise(state["spans"]).alias("spans"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, formatted, loss_spans (start, length; code points), n_blocks."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = sorted_turns.select("conv_id", F.aggregate("turns", F.lit(None).cast(_BLOCKS), lambda b, t: _merge(F.coalesce(b, F.array().cast(_BLOCKS)), t)).alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(OPENED), F.array_join(b["texts"], NEXT), F.lit(CLOSE))), "")
    spans = F.aggregate("blocks", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans")), _place)
    return blocks.select("conv_id", formatted.alias("formatted"), spans["spans"].alias("loss_spans"), F.size("blocks").cast("long").alias("n_blocks"))


def read_turns(formatted: Column) -> Column:
    """The formatted string back as array<struct<role, text>> of the single turns, in order."""
    blocks = F.filter(F.split(formatted, F.lit(CLOSE)), lambda b: b != "")
    parts = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.substring(b, F.locate(OPENED, b) + 1, F.length(b)), F.lit(NEXT), -1),
            lambda t: F.struct(unescape(F.substring(b, F.lit(len(OPEN) + 1), F.locate(OPENED, b) - len(OPEN) - 1)).alias("role"), unescape(t).alias("text")),
        ),
    )
    return F.flatten(parts)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from formatted chats."""
    back = formatted.select("conv_id", "formatted", "n_blocks", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


#: The conversation that the contract adds: control strings of common templates, and a backslash.
PLANTED = "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_digests(format_chats(turns))


OP7_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', ''))) + 3 * (length(text) - length(replace(text, '>', ''))) AS text_chars,
             CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) THEN 0 ELSE 1 END AS begins FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN begins = 1 THEN 6 + length(role) + 1 + 8 ELSE 6 END) AS BIGINT) AS formatted_chars,
       CAST(sum(begins) AS BIGINT) AS n_blocks
FROM e GROUP BY conv_id
"""
