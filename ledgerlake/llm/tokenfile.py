"""Operator 3, token ids in files of independent zstandard frames with a trailing seek table.

File layout. Each frame is one zstandard frame, compressed on its own, holding the ids of whole documents (little-endian
unsigned 32-bit, the end id last), about FRAME_IDS of them or one longer document. A skippable frame follows: the document
index (doc ids, their frame and token counts). The last skippable frame is the seek table of the zstandard seekable
format: for each frame its compressed and its raw size and a checksum (the low 32 bits of xxHash64 of the raw bytes),
then a footer. A reader takes the tail of a file, finds a document's frame, checks and decompresses that frame only.

Writing is deterministic in (documents, partitioning): an attempt writes to a name of its own and renames it, so a lost
executor's task just runs again. A task begins a new file after FILE_IDS ids. Files cover ascending ranges of doc_id; `files` lists them with their token counts, and
a prefix sum over that small list gives each file its first token's place.

Defined results: a null or empty text is one document with only the end id; null doc_ids come first; rows that repeat a
doc_id are documents of their own, ordered by their first 32 bytes, then by a hash; an empty table gives no file and no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import Bounded, bound_batches, give_back, new_path, save, table, temp_name, utf8
from ledgerlake.llm.words import CHECK, EXACT, groups, hashes, places

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Ids a frame holds before the next document begins a new one.
FRAME_IDS = 1 << 16

#: Fixed values of the zstandard skippable and seekable formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "<u4"), ("frame", "<u4"), ("n_tokens", "<u8")])


#: Closing punctuation that is a pre-token of its own after a letter or digit.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?*$%&#")] = True
_LONGEST_TAIL = 4
_LETTER = np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Pieces remembered in a task (twice as many at most), and the longest piece that is.
_MEMO, _LONGEST = 100_000, 64
#: Bytes of text whose words are told apart at once.
_GROUP = 1 << 21

#: The normalizer and the pre-tokenizer under which words can be encoded apart from each other.
_SEPARABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def is_separable(tokenizer) -> bool:
    """Whether blanks give no tokens, case does not matter and closing punctuation stands alone, so that words can be encoded one by one."""
    import json

    made = json.loads(tokenizer.to_str())
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|") for t in made["added_tokens"])
    return plain and made["model"]["type"] == "BPE" and not made["model"].get("dropout") and all(made[k] == v for k, v in _SEPARABLE.items())


class Encoder:
    """Texts of a binary column -> their ids as little-endian uint32 bytes.

    With a separable tokenizer each distinct word of some MB is encoded once, by the library's model, and its ids are set in for every
    occurrence with array operations. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.separable = is_separable(self.tokenizer)
        self.model, self.normalizer, self.pre = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.memo = Bounded(self.piece, _MEMO, longest=_LONGEST)

    def piece(self, raw: bytes) -> bytes:
        """The ids of a piece without blanks."""
        from array import array

        if raw.isascii() and raw.isalpha() and raw.islower():
            parts = [raw.decode()]
        else:
            text = raw.decode("utf-8", "replace")
            if b"<|" in raw:  # may hold a special token
                return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            if text.isalpha() and max(text) < "\u0180" and text == text.lower():  # normal already, and one pre-token
                parts = [self.bytes.pre_tokenize_str(text)[0][0]]
            else:
                parts = [p for p, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return array("I", [t.id for p in parts for t in self.model.tokenize(p)]).tobytes()

    def __call__(self, column: pa.Array) -> Iterator[bytes]:
        if self.separable:
            for data, offsets in groups(column, _GROUP):
                yield from self._group(data, offsets)
        else:
            for raw in column:
                ids = self.tokenizer.encode((raw.as_py() or b"").decode("utf-8", "replace"), add_special_tokens=False).ids
                yield np.array(ids, "<u4").tobytes()

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        begins, ends, counts = places(data, offsets)
        low = _LOWER[data]
        wide, upper = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (data >= 128, low != data))
        special = np.zeros(len(begins), bool)
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # <|
        special[np.maximum(0, np.searchsorted(begins, marks, "right") - 1)] = len(begins) > 0
        as_it_is = special | ((wide[ends] > wide[begins]) & (upper[ends] > upper[begins]))
        if as_it_is.any():  # normalization comes before lower case
            edge = np.zeros(len(data) + 1, np.int8)
            edge[begins[as_it_is]] += 1
            edge[ends[as_it_is]] -= 1
            inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            low[inside] = data[inside]
        stems = ends.copy()
        for _ in range(_LONGEST_TAIL):
            stems -= (stems > begins) & _TAIL[low[stems - 1]]
        split = (stems > begins) & (stems < ends) & _LETTER[low[stems - 1]] & ~special
        at = np.cumsum(1 + split) - 1 - split  # each word's first piece
        first, last = np.empty(len(begins) + int(split.sum()), np.int64), np.empty(len(begins) + int(split.sum()), np.int64)
        first[at], last[at] = begins, np.where(split, stems, ends)
        first[at[split] + 1], last[at[split] + 1] = stems[split], ends[split]
        of_text = np.concatenate([at, [len(first)]])[np.concatenate([[0], np.cumsum(counts)])]
        del begins, ends, counts, wide, upper, special, marks, as_it_is, stems, split, at, data  # while the ids go out, only they are held
        yield from self._pieces(low, first, last, of_text)

    def _pieces(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, of_text: np.ndarray) -> Iterator[bytes]:
        """Ids of the texts whose pieces are of_text[i] to of_text[i + 1]."""
        h = hashes(data, first, last, EXACT)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        check = hashes(data, first, last, CHECK)
        if (check[one][which] != check).any():  # different pieces under one hash: tell them apart by both
            pairs = np.empty(len(h), np.dtype([("h", np.uint64), ("check", np.uint32)]))
            pairs["h"], pairs["check"] = h, check
            _, one, which = np.unique(pairs, return_index=True, return_inverse=True)
        raw, memo = data.tobytes(), self.memo
        del h, check
        ids = [memo[raw[a:b]] for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True)]
        del raw, one
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        begins = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(ids), "<u4")
        n = sizes[which]
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(stops) else 0
        place = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        out = flat[np.repeat((begins[which] - (stops - n)).astype(place), n) + np.arange(total, dtype=place)] if total else flat
        bounds = np.concatenate([[0], stops])[of_text]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield out[a:b].tobytes()


class FrameWriter:
    """Collects documents into frames; close() appends the index and the seek table."""

    def __init__(self, sink, level: int = 3):
        import xxhash
        import zstandard

        self.sink, self.hash, self.zstd = sink, xxhash.xxh64_intdigest, zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.n_pending = 0
        self.docs: list[tuple] = []
        self.frames: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.n_pending and self.n_pending + len(ids) // 4 > FRAME_IDS:
            self.flush()
        self.docs.append((doc_id or 0, doc_id is not None, len(self.frames), len(ids) // 4))
        self.pending.append(ids)
        self.n_pending += len(ids) // 4

    def flush(self) -> None:
        raw = b"".join(self.pending)
        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), self.hash(raw) & 0xFFFFFFFF))
        self.pending, self.n_pending = [], 0

    def close(self) -> None:
        if self.pending:
            self.flush()
        index = self.zstd.compress(np.array(self.docs, _DOC).tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        # The index's size stands before the seek table as a skippable frame of its own, so a reader finds it from the end.
        self.sink.write(struct.pack("<III", SKIPPABLE_INDEX + 1, 4, 8 + len(index)))
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Random access to one file. Only the tail and the frames that are asked for are read."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        begin = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(begin, 12 * n), "<u4").reshape(n, 3)
        self.begins = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        (length,) = struct.unpack("<I", self._at(begin - 12, 4))
        import xxhash
        import zstandard

        self.hash, self.zstd = xxhash.xxh64_intdigest, zstandard.ZstdDecompressor()
        raw = self._at(begin - 20 - (length - 8), length - 8)
        self.docs = np.frombuffer(self.zstd.decompress(raw), _DOC)

    def _at(self, begin: int, n: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        packed, raw_size, check = (int(x) for x in self.frames[k])
        raw = self.zstd.decompress(self._at(int(self.begins[k]), packed), max_output_size=raw_size)
        if len(raw) != raw_size or self.hash(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, place of its first token in this file, its ids) of the wanted documents, or of all."""
        starts = np.concatenate([[0], np.cumsum(self.docs["n_tokens"], dtype=np.int64)])
        at, raw, base = -1, b"", 0
        for i, (doc_id, has_id, frame, n) in enumerate(self.docs.tolist()):
            doc_id = doc_id if has_id else None
            if wanted is not None and doc_id not in wanted:
                continue
            if frame != at:
                at, raw = frame, self.frame(frame)
                base = int(starts[np.searchsorted(self.docs["frame"], frame)])
            offset = 4 * (int(starts[i]) - base)
            yield doc_id, int(starts[i]), raw[offset : offset + 4 * n]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


FILES = "path string, part int, place int, n_docs bigint, n_tokens bigint"
#: Ids after which the next document begins a new file.
FILE_IDS = 1 << 26


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, raw in ascending order over partitions. Rows of one doc_id may fill several: they are dealt by their text's first bytes
    and hash, and copies by their place in the input."""
    copies = F.xxhash64(F.monotonically_increasing_id())
    keys = {"__a": F.substring("raw", 1, 32), "__b": F.xxhash64("raw"), "__c": copies}
    slim = bound_batches(docs).select("doc_id", utf8().alias("raw")).withColumns(keys)
    return slim.repartitionByRange("doc_id", *keys).sortWithinPartitions("doc_id", *keys).select("doc_id", "raw")


class Rolling:
    """Files of one task, each whole before it gets its name. A failed attempt leaves none behind."""

    def __init__(self, folder: str, stem: str):
        self.folder, self.stem, self.writer, self.rows = folder, stem, None, []
        self.fs, self.root = filesystem(folder)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.writer is None:
            self.fs.create_dir(self.root, recursive=True)
            self.attempt = temp_name(f"{self.root}/{self.stem}")
            self.sink = self.fs.open_output_stream(self.attempt)
            self.writer, self.n = FrameWriter(self.sink), 0
        self.writer.add(doc_id, ids)
        self.n += len(ids) // 4
        if self.n >= FILE_IDS:
            self.close()

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
            self.sink.close()
            name = f"{self.stem}-{len(self.rows):05d}.zst"
            self.fs.move(self.attempt, f"{self.root}/{name}")
            self.rows.append((f"{self.folder}/{name}", len(self.rows), len(self.writer.docs), self.n))
            self.writer = None

    def give_up(self) -> None:
        if self.writer is not None:
            self.sink.close()
            self.fs.delete_file(self.attempt)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode docs(doc_id, text) in ascending order of doc_id into files under `folder`, and return the list of files."""
    job = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end = Encoder(tokenizer_path), struct.pack("<I", end_id)
        out = Rolling(folder, f"{job}-{part:06d}")
        try:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                    out.add(doc_id, ids + end)
            out.close()
        except BaseException:
            out.give_up()
            raise
        paths, place, n_docs, n_tokens = zip(*out.rows, strict=True) if out.rows else ((), (), (), ())
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "part": pa.array([part] * len(paths), pa.int32()), "place": pa.array(place, pa.int32()), "n_docs": pa.array(n_docs, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})
        del encode, out
        give_back()

    return save(_ordered(docs).mapInArrow(write, FILES), "token-files")


def read_token_files(files: DataFrame, wanted: set | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (bytes) from the files, whole or only the `wanted` documents."""
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A fixed number of partitions: the few bytes of this list must not let the files' readers be merged into one task.
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = files.select("path", base.alias("base")).repartition(n, "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as file:
                    rows: list[tuple] = []
                    held = 0
                    for doc_id, start, ids in FrameReader(file).documents(wanted):
                        rows.append((doc_id, first + start, len(ids) // 4, ids))
                        held += len(ids)
                        if held > 1 << 22:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)
        give_back()

    return placed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def digests(read: DataFrame) -> DataFrame:
    """Per document its place, its count and the unsigned crc32 of its ids."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    files = write_token_files(docs, new_path(spark, "tokens"), tokenizer_path or tokenizer_file())
    return digests(read_token_files(files))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(spark, table(spark, sf_dir, "documents"))
