"""Token-ID output: ids packed in the fewest bits, with block offsets for random access.

A file is, all integers little-endian:

    magic b"GLTOK1\\0\\0" | bits u32 | block u32            16 bytes
    blocks, each `block` ids (the last may have fewer), packed at `bits` bits, low bits first, from a byte's start
    doc_ids i64[n] | null flags u8[n] | starts u64[n + 1]   the index; starts are in ids, within the file
    block offsets u64[b + 1]                                in bytes, from the file's start
    n u64 | ids u64 | b u64 | magic                         the last 32 bytes
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from gleaner.llm.common import new_folder, table

MAGIC = b"GLTOK1\0\0"
BLOCK_IDS = 1 << 16
#: Words remembered by an encoder, at about 200 bytes each: its tasks share it.
MEMO_WORDS = 1_500_000
STOPS = tuple(".,;:!?")
_BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")


def min_bits(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """uint32 ids at `bits` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(flags, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first `n` ids, as uint32: each is read from the 8 bytes that it begins in."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    at = np.arange(n, dtype=np.int64) * bits
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))[at >> 3].copy().view("<u8")[:, 0]
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Streams documents to one file; blocks go out as they fill."""

    def __init__(self, sink, bits: int, block: int = BLOCK_IDS):
        self.sink, self.bits, self.block = sink, bits, block
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.starts, self.offsets, self.at = [0], [16], 16
        self.held: list[bytes] = []
        self.held_ids = 0
        sink.write(MAGIC + struct.pack("<II", bits, block))

    def _out(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """`ids`: little-endian unsigned 32-bit."""
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        if self.held_ids >= self.block:
            ready = np.frombuffer(b"".join(self.held), "<u4")
            full = len(ready) // self.block * self.block
            for k in range(0, full, self.block):
                self._out(ready[k : k + self.block])
            self.held, self.held_ids = [ready[full:].tobytes()], len(ready) - full

    def close(self) -> None:
        if self.held_ids:
            self._out(np.frombuffer(b"".join(self.held), "<u4"))
        self.sink.write(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.sink.write(struct.pack("<QQQ", len(self.doc_ids), self.starts[-1], len(self.offsets) - 1) + MAGIC)
        self.sink.close()


class TokenFile:
    """Random access by document number or by id range; only the index stays in memory."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, self.n_ids, b, magic = struct.unpack("<QQQ8s", source.read_at(32, size - 32))
        head = source.read_at(16, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block = struct.unpack("<II", head[8:])
        index = source.read_at(n * 9 + (n + 1) * 8 + (b + 1) * 8, size - 32 - (n * 9 + (n + 1) * 8 + (b + 1) * 8))
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, np.uint8, n, n * 8).astype(bool)
        self.starts = np.frombuffer(index[n * 9 : n * 9 + (n + 1) * 8], "<u8").astype(np.int64)
        self.offsets = np.frombuffer(index[n * 9 + (n + 1) * 8 :], "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from `start` up to `stop`; reads the blocks that hold them."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        out = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            a, b = int(self.offsets[k] - self.offsets[first]), int(self.offsets[k + 1] - self.offsets[first])
            out.append(unpack(data[a:b], self.bits, n))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every document's number and ids, reading about `ids_at_once` ids at a time."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            to = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + ids_at_once, "right")) - 1)
            chunk = self.ids(int(self.starts[k]), int(self.starts[to]))
            for j in range(k, to):
                yield j, chunk[self.starts[j] - self.starts[k] : self.starts[j + 1] - self.starts[k]]
            k = to


#: Pre-tokenizers that part texts at all blanks, drop these, and look at nothing beyond.
_AT_BLANKS = ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
#: Alternatives of a pattern of pieces that match no blank and look at nothing beyond: a run or one of letters, of numbers, of all else; and an apostrophe with letters.
_PIECES = ("[\\p{L}]+", "\\p{L}+", "[\\p{N}]", "\\p{N}", "[\\p{N}]+", "\\p{N}+", "[^\\s\\p{L}\\p{N}]+")


def local_rules(settings: dict) -> tuple[bool, bool, bool]:
    """(splits, lower, stops) of a tokenizer's settings: whether what stands between blanks is encoded on its own, case is ignored, and a word is parted from a stop after it.

    Normalizers must be the canonical composition, lower case, or blanks made one: none of them looks past a blank. The pre-tokenizer must begin with a
    step that parts at all blanks: one of those known to, or the matches alone of a pattern of `_PIECES`. Anything else is taken to look further.
    """
    steps = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    norms, first = steps(settings["normalizer"], "normalizers"), (steps(settings["pre_tokenizer"], "pretokenizers") or [{"type": None}])[0]
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    known = all(n["type"] in ("NFC", "Lowercase") or n == blanks for n in norms) and not settings["truncation"] and not settings["padding"]
    pieces = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex", "").split("|")
    of_pieces = bool(pieces) and all(x in _PIECES or re.fullmatch("'[a-z]+", x) for x in pieces)
    splits = known and (of_pieces or first["type"] in _AT_BLANKS)
    stops = splits and of_pieces and any(x in _PIECES[:2] for x in pieces) and _PIECES[-1] in pieces
    return splits, splits and any(n["type"] == "Lowercase" for n in norms), stops


_ENCODERS: dict[tuple[str, int], "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts as the tokenizer does, remembering the ids of what stands between blanks.

    For tokenizers whose tokens never span a space or a line feed, and that drop these: the ids of a
    text are then those of its pieces in turn. `local_rules` proves it from the tokenizer's own normalizer and pre-tokenizer; of any other tokenizer
    whole texts are encoded. Where the tokenizer ignores case, Latin texts are remembered in lower case; where it
    parts a word from a stop after it (`stops`), the word is remembered once for all stops. Texts that hold an added token's string are encoded whole as well.

    Memory: words are remembered in two generations of `memo_words` / 2. When the new one is full, it takes the place
    of the old one, and those still in use come back from there, so frequent words stay whatever else comes by.
    Only the words of the text at hand go beyond that.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splits, self.lower, self.stops = local_rules(json.loads(self.tokenizer.to_str()))
        self.memo_words = memo_words
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, little-endian."""
        if not text:
            return b""
        if not self.splits or any(a in text for a in self.added):
            return self._ids(text)
        if self.lower and (text.isascii() or not _BEYOND_LATIN.search(text)):
            text = text.lower()
        if len(self.memo) > self.memo_words // 2:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        words = text.replace("\n", " ").split(" ")
        fresh = []
        for w in set(words).difference(memo):
            if w in old:
                memo[w] = old[w]
            else:
                fresh.append(w)
        if fresh:
            stopped = [w for w in fresh if self.stops and w[-1:] in STOPS and w[-2:-1].isalpha()]
            parts = {w[:-1] for w in stopped} | {w[-1] for w in stopped} | set(fresh).difference(stopped)
            parts = [w for w in parts if w not in memo]
            for w, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
                memo[w] = np.array(e.ids, "<u4").tobytes()
            for w in stopped:
                memo[w] = memo[w[:-1]] + memo[w[-1]]
        return b"".join([memo[w] for w in words])


def encoder(path: str, memo_words: int = MEMO_WORDS) -> WordEncoder:
    if (path, memo_words) not in _ENCODERS:
        _ENCODERS[path, memo_words] = WordEncoder(path, memo_words)
    return _ENCODERS[path, memo_words]


MANIFEST = "part bigint, roll bigint, file string, n_docs bigint, n_ids bigint"
#: A task goes on to a new file when one has so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 22


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, partitions: int | None = None, memo_words: int = MEMO_WORDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode `docs` (doc_id, text) into files below `folder`, in ascending doc_id order; returns the manifest.

    Manifest rows: part and roll (files in this order hold ascending doc_ids), file, n_docs, n_ids. Null texts are
    empty ones; null ids come first; rows with the same id are ordered by text. Each document ends with
    `end_id`. Other columns are ignored. A task begins a new file when one has `file_ids` ids. It writes under names of its own and renames
    files when they are done, so a task that runs again, or twice at once, leaves the same files. An empty table gives no files.
    """
    spark = docs.sparkSession
    bits = min_bits(max(encoder(tokenizer_path, memo_words).vocabulary, end_id + 1))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, place = open_store(folder)
        store.create_dir(place, recursive=True)
        writer, passing, roll, codec = None, "", 0, encoder(tokenizer_path, memo_words)

        def done() -> pa.RecordBatch:
            writer.close()
            name = f"part-{part:08d}-{roll:05d}.tok"
            store.move(passing, posixpath.join(place, name))
            return pa.RecordBatch.from_pydict({"part": [part], "roll": [roll], "file": [name], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.starts[-1]]})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    passing = posixpath.join(place, f"_{part:08d}-{uuid.uuid4().hex}")
                    writer = TokenFileWriter(store.open_output_stream(passing, compression=None), bits)
                writer.add(doc_id, codec.encode(text.as_py()) + end)
                if writer.starts[-1] >= file_ids or len(writer.doc_ids) >= FILE_DOCS:
                    yield done()
                    writer, roll = None, roll + 1
        if writer:
            yield done()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, MANIFEST)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it, in all files; ids_crc32 is over its ids as
    little-endian unsigned 32-bit integers. A task reads blocks, never a whole file.
    """
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(posixpath.join(place, row["file"])) as source:
                    f = TokenFile(source)
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in f.documents()]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(f.doc_ids, pa.int64(), mask=f.nulls),
                        "start": pa.array(f.starts[:-1] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(f.starts), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Write `docs` as token files (to `folder`, else a new one in the shared folder) and read them back."""
    from gleaner.llm.common import cut

    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read_token_files(cut(write_token_files(docs, folder, tokenizer_path, end_id, memo_words=memo_words)), folder)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`token_output` of all documents with the 49k word tokenizer; documents end with id 1."""
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
