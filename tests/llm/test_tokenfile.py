import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import common, tokenfile

SCHEMA = "doc_id bigint, text string, path string, raw string"
TEXTS = ["", None, "hello  world's\nbest", "tab\tand no-break   line", "<|endoftext|> inside", "é é İ ß ſ Kelvin K", "x" * 3000, "١٢٣ 12,5 !!??", "a b " * 400_00, "\u0000nul", "日本語 テスト 🙂🙂"]


def expected(rows):
    t = Tokenizer.from_file(tokenfile.tokenizer_file())
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_equals_whole_text_encoding_and_orders_by_doc_id(spark):
    rows = [(i * 7 % 11, t) for i, t in enumerate(TEXTS)]
    got = tokenfile.write_and_read(spark, spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == expected(sorted(rows, key=lambda r: r[0]))


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "z"), (3, "b"), (3, "b"), (3, "a")]
    got = tokenfile.write_and_read(spark, spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected([(None, "z"), (3, "a"), (3, "b"), (3, "b")])
    assert tokenfile.write_and_read(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_readers_take_only_wanted_documents_and_notice_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * 5000, "", "") for i in range(40)], SCHEMA)
    folder = common.new_path(spark, "t")
    files = tokenfile.write_token_files(docs, folder, tokenfile.tokenizer_file())
    assert sorted(r.doc_id for r in tokenfile.read_token_files(files, {5, 31}).collect()) == [5, 31]
    path = files.first().path
    fs, inner = tokenfile.filesystem(path)
    data = bytearray(fs.open_input_file(inner).read())
    reader = tokenfile.FrameReader(fs.open_input_file(inner))
    assert len(reader.frames) > 2
    packed = bytes(data[: reader.frames[0][0]])
    import zstandard

    assert len(zstandard.decompress(packed)) == reader.frames[0][1]
    data[-12 * len(reader.frames) - 9 + 8] ^= 1  # the first frame's checksum
    bad = tmp_path / "bad.zst"
    bad.write_bytes(bytes(data))
    with pytest.raises(ValueError):
        list(tokenfile.FrameReader(tokenfile.filesystem(str(bad))[0].open_input_file(str(bad))).documents())


def test_pieces_in_groups_equal_whole_texts():
    import random

    t = Tokenizer.from_file(tokenfile.tokenizer_file())
    rng = random.Random(3)
    parts = ["a", "Word", "É", "é", "é", "H̱", "İ", "İ", ".", "!!", "!!!!!!!", "'s", "'S", "\"", "«", "…", "9", "12,5", " ", " ", " ", "\n", "\t", " ", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "#", "$%&", "ß", "Straße", "\x1c", "-", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(1500)]
    encode = tokenfile.Encoder(tokenfile.tokenizer_file())
    assert encode.separable
    got = list(encode(tokenfile.pa.array([x.encode() for x in texts], tokenfile.pa.binary())))
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_another_tokenizer_gets_whole_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, x) for i, x in enumerate(["Upper lower  two blanks\n\nlines", "", None, "it's  3.5"])]
    got = tokenfile.write_and_read(spark, spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), path).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {i: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in rows}


def test_files_roll_and_a_failed_attempt_leaves_nothing(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 1000)
    rows = [(i, f"w{i} " * 300) for i in range(50)] + [(7, "same row")] * 40
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    folder = common.new_path(spark, "roll")
    files = tokenfile.write_token_files(docs, folder, tokenfile.tokenizer_file())
    assert files.count() > 20
    got = sorted(map(tuple, tokenfile.digests(tokenfile.read_token_files(files)).collect()), key=lambda r: r[1])
    assert sorted(r[0] for r in got) == [r[0] for r in got] and len(got) == 90
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(90)]
    fs, root = tokenfile.filesystem(folder)
    out = tokenfile.Rolling(folder, "failed")
    out.add(1, b"\0" * 400)
    out.give_up()
    names = [f.path for f in fs.get_file_info(tokenfile.pafs.FileSelector(root))]
    assert names and not [n for n in names if n.endswith(".tmp")]
