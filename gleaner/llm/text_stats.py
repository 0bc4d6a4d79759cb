"""Counts over whole texts that the quality operators start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
_SPACES = [9, 10, 11, 12, 13, 32]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_PUNCTUATION = [ord(c) for c in ".,;:?\"'()-"]
_MIX = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, np.uint64) | np.uint64(1)

#: The counts, in order; all are integers.
COUNTS = [
    "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
    "n_upper", "n_letters", "n_digits", "n_punctuation", "n_bangs", "n_pipes", "n_wide", "longest_word", "n_same_next",
]


def repeat_words(hashes: np.ndarray) -> int:
    """How many words lie in a window of 8 that is found twice or more; words come as 64-bit hashes."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    key = hashes[:n] * _MIX[0]
    for k in range(1, WINDOW):
        key += hashes[k : k + n] * _MIX[k]
    order = np.sort(key)
    again = order[1:] == order[:-1]
    if not again.any():
        return 0
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(key, order[1:][again]))
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: str | None) -> list[int]:
    """COUNTS of one text; null is the empty text."""
    data = (text or "").encode()
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    wide = int(byte[192:].sum())
    n_chars = int(byte[:128].sum()) + wide
    words = data.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    lines, seen, dup = data.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    return [
        n_chars, len(words), n_chars - int(byte[_SPACES].sum()), int(byte[_SYMBOLS].sum()), len(lines), dup, repeat_words(hashes), len(set(words)),
        upper, upper + lower + wide, int(byte[48:58].sum()), int(byte[_PUNCTUATION].sum()), int(byte[33]), int(byte[124]), wide,
        max(map(len, words), default=0), int((hashes[1:] == hashes[:-1]).sum()),
    ]


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS for each row of `docs` (doc_id, text); other columns are ignored."""
    names = ["doc_id", *COUNTS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_counts(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, ", ".join(f"{c} bigint" for c in names))
