import hashlib

from ledgerlake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, turns string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """conv -> (n_turns, turns digest, loss chars, loss digest)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{role}\n{x}\n" for *_, role, x in turns)), len(loss), sha(loss))
    return out


HARD = ["", "</turn>\n", "<next>", "<turn:user>x", "&lt;&amp;lt;", "a\n\nb", "\\### Assistant: </turn> ok", "🙂é", "&" * 50, "<<>>"]
ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 3, "user", None), (1, 4, "user", "x"), (1, 5, "assistant", "c")]
ROWS += [(2, i, ["user", "assistant", "a>b<c", None][i % 4], t) for i, t in enumerate(HARD)]
ROWS += [(3, None, "assistant", "late"), (3, None, "assistant", "late"), (3, 1, "system", "s"), (None, 0, "user", "no id"), (4, 7, "assistant", "y" * 200_000)]


def test_read_back_equals_the_rows(spark):
    df = chat.format_chats(spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(df).collect()}
    assert got == brute(ROWS)


def test_merged_blocks_escapes_and_spans(spark):
    df = chat.format_chats(spark.createDataFrame([(*r, "", "") for r in ROWS], SCHEMA))
    one = df.where("conv_id = 1").first()
    assert one.formatted == "<turn:user>hi</turn>\n<turn:assistant>a<next>b</turn>\n<turn:user><next>x</turn>\n<turn:assistant>c</turn>\n" and one.n_blocks == 4
    assert [one.formatted[s.start : s.start + s.length] for s in one.loss_spans] == ["a", "b", "c"]
    two = df.where("conv_id = 2").first().formatted
    assert two.count("</turn>\n") == len(HARD) and "&lt;/turn&gt;" in two


def test_no_python_in_the_plan_and_empty_table(spark):
    df = chat.chat_digests(chat.format_chats(spark.createDataFrame([], SCHEMA)))
    assert df.collect() == []
    assert "Python" not in df._jdf.queryExecution().toString()
