"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Documents that share a seed with a test item are aligned with it around the seed, unless the words that they share
are too few for the similarity asked for. A seed is four words: in a row, or with one word between that may be any, so an item with every
third word changed still has seeds. No seed is left out for being frequent. Seeds are looked up in the benchmark's, which are
broadcast in blocks of a bounded size, so documents aren't shuffled, and a passage that a third of them hold is work for every task alike.
Words are runs of letters and digits; where a script writes no spaces, each character is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import cut, row_key, table

_WORDS = re.compile(r"\w+")
#: Thai, Lao, Myanmar, Khmer, Japanese syllables, Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
#: Where the words of a seed stand. Fewer than SEED_WORDS words make no seed.
SHAPES = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 3, 4))
SEED_WORDS = 4
#: So many cells of alignment rows are held at once.
CELLS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, 1
#: A block of the benchmark has about so many words at most: what the driver holds and broadcasts at once.
BLOCK_WORDS = 2_000_000
_BITS = 22


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return _WORDS.findall(low if low.isascii() else _UNSPACED.sub(r" \g<0> ", low))


@dataclass
class Items:
    """A block of test items: their words as numbers, and the seeds of these."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: np.ndarray  # distinct seed keys, sorted
    places: np.ndarray  # rows (seed number, item number, offset), sorted
    filter: np.ndarray  # bool by the low bits of a key
    short: dict[tuple[str, ...], list[int]]  # the numbers of items of too few words for a seed

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> "Items":
        vocabulary: dict[str, int] = {}
        ids, words, short = [], [], {}
        for item_id, text in rows:
            if not (w := words_of(text)):
                continue
            if len(w) < SEED_WORDS:
                short.setdefault(tuple(w), []).append(len(ids))
            ids.append(item_id)
            words.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64))
        keys, places = [np.empty(0, np.uint64)], [np.empty((0, 2), np.int64)]
        for k, w in enumerate(words):
            for shape in range(len(SHAPES)):
                at = np.arange(max(0, len(w) - SHAPES[shape][-1]))
                keys.append(seed_keys(w, at, shape))
                places.append(np.stack([np.full(len(at), k), at], axis=1))
        seeds, number = np.unique(np.concatenate(keys), return_inverse=True)
        places = np.concatenate([number.reshape(-1, 1), np.concatenate(places)], axis=1)
        return Items(ids, words, vocabulary, seeds, places[np.lexsort((places[:, 2], places[:, 1], places[:, 0]))], _filter(seeds), short)

    def look_up(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text's words as numbers (-1: in no item), and positions and numbers of the seeds in it."""
        get = self.vocabulary.get
        w = np.array([get(x, -1) for x in words_of(text)], np.int64)
        known, ats, numbers = w >= 0, [], []
        for shape, offsets in enumerate(SHAPES):
            n = len(w) - offsets[-1]
            if n <= 0 or not len(self.seeds):
                continue
            whole = known[:n].copy()
            for o in offsets[1:]:
                whole &= known[o : o + n]
            at = np.flatnonzero(whole)
            key = seed_keys(w, at, shape)
            maybe = self.filter[(key & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
            at, key = at[maybe], key[maybe]
            number = np.searchsorted(self.seeds, key)
            hit = self.seeds[np.minimum(number, len(self.seeds) - 1)] == key
            ats.append(at[hit])
            numbers.append(number[hit])
        none = np.empty(0, np.int64)
        return w, np.concatenate([none, *ats]), np.concatenate([none, *numbers])

    def short_lines(self, text: str | None) -> Iterator[tuple[int, float, int]]:
        """(item number, similarity, word) for each short item that is a line of the text, once."""
        seen, before = set(), 0
        for line in (text or "").split("\n") if self.short else ():
            w = words_of(line)
            for k in self.short.get(tuple(w), ()) if len(w) < SEED_WORDS else ():
                if k not in seen:
                    seen.add(k)
                    yield k, 1.0, before
            before += len(w)


def seed_keys(words: np.ndarray, at: np.ndarray, shape: int) -> np.ndarray:
    """The keys of the seeds of a shape that begin at `at`."""
    key = np.full(len(at), shape, np.uint64)
    for o in SHAPES[shape]:
        x = (key ^ (words[at + o].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        key = x ^ (x >> np.uint64(29))
    return key


def _filter(seeds: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, bool)
    bits[(seeds & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return bits


def smith_waterman(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The best local alignment score of `item` with each row of `windows` (-1: matches nothing), linear gaps.

    All windows advance together, a word of the item at a time; a gap along a row is a running maximum.
    """
    slope = GAP * np.arange(windows.shape[1] + 1, dtype=np.int32)
    row, best = np.zeros((len(windows), windows.shape[1] + 1), np.int32), np.zeros(len(windows), np.int32)
    for word in item:
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(0, np.maximum(row[:, :-1] + np.where(windows == word, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] - GAP))
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        best = np.maximum(best, row.max(axis=1))
    return best


def align(items: Items, words: np.ndarray, at: np.ndarray, seed: np.ndarray, min_similarity: float) -> Iterator[tuple[int, float, int]]:
    """(item number, similarity, word where its window begins) for each item that shares a seed with the document and reaches `min_similarity`.

    Similarity is the score over that of the whole item. Windows reach from where the item would begin
    and end by any of its seeds, with some words to spare. Windows in which too few words are any of the item's to reach
    `min_similarity` are passed over; they can't.
    """
    first, last = np.searchsorted(items.places[:, 0], seed, "left"), np.searchsorted(items.places[:, 0], seed, "right")
    n = last - first
    place = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    item, begin = items.places[place, 1], np.repeat(at, n) - items.places[place, 2]
    pairs = np.unique(np.stack([item, begin], axis=1), axis=0)
    cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
    for k, starts in zip(pairs[np.concatenate([[0], cuts]), 0] if len(pairs) else [], np.split(pairs[:, 1], cuts), strict=True):
        whole = items.words[k]
        m, spare = len(whole), len(whole) // 3 + SEED_WORDS
        anchors = starts[np.concatenate([[True], np.diff(starts // max(1, spare)) > 0])]  # one window for starts that lie close
        size, best, where = m + 3 * spare, -1, 0
        low = anchors // max(1, spare) * spare - spare
        a, b = max(0, int(low[0])), min(len(words), int(low[-1]) + size)
        shared = np.concatenate([[0], np.cumsum(np.isin(words[a:b], whole))])
        enough = shared[np.clip(low + size - a, 0, b - a)] - shared[np.clip(low - a, 0, b - a)] >= min_similarity * m
        low = low[enough]
        at_once = max(1, min(256, CELLS // size))
        for c in range(0, len(low), at_once):
            here = low[c : c + at_once]
            index = here[:, None] + np.arange(size)
            inside = (index >= 0) & (index < len(words))
            score = smith_waterman(whole, np.where(inside, words[np.clip(index, 0, len(words) - 1)], -1))
            if score.max() > best:
                best, where = int(score.max()), max(0, int(here[int(score.argmax())]))
        if best >= max(0, min_similarity * MATCH * m):
            yield int(k), best / (MATCH * m), where


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    b = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull()))
    total = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / 4
    n = int(total // block_words) + 1
    for k in range(n):
        rows = b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about block_words words
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_similarity: float = 0.5, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of `docs` and test item that it holds: the columns `keep` (integers or binary), item_id, similarity, word.

    similarity is the Smith-Waterman score (match 2, mismatch -1, gap -1, over words in lower case) as a share of
    what the whole item would score; word is about where the passage begins. Seeds are all of an item, however frequent. An item of fewer
    than four words has none: it is found where a line of the text is it, word for word. Items and texts that are null or without a
    word match nothing. Repeated documents or items each give their rows. Other columns are ignored.

    Measured against alignment without seeds, on items of 10 to 60 words: with every third, fourth or fifth word changed all that reach
    0.5 are found; with a fifth to a third of the words changed, left out or inserted at random 0.91 to 1.

    A benchmark larger than `block_words` words is worked off in blocks, each a pass over the documents.
    """
    spark = docs.sparkSession
    kinds = {c: "binary" if docs.schema[c].dataType.simpleString() == "binary" else "bigint" for c in keep}
    whole = docs.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keep], F.col("text").alias("_text"))
    schema = ", ".join([*[f"{c} {kind}" for c, kind in kinds.items()], "item_id bigint, similarity double, word bigint"])
    out = None
    for rows in _blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(Items.of(rows))

        def leaks(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                at, found = [], []
                for i, t in enumerate(batch.column("_text")):
                    text = t.as_py()
                    words, where, seed = items.look_up(text)
                    hits = [*(align(items, words, where, seed, min_similarity) if len(seed) else ()), *items.short_lines(text)]
                    at += [i] * len(hits)
                    found += hits
                kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in keep]
                cols = [pa.array([items.ids[k] for k, _, _ in found], pa.int64()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([w for _, _, w in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *cols], [*keep, "item_id", "similarity", "word"])

        part = whole.mapInArrow(leaks, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` (doc_id, text and others) that hold no test item."""
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))  # so that no column of theirs can clash
    d = whole.withColumn("_row", row_key(F.col("doc.doc_id"), F.col("doc.text")))
    bad = find_leaks(d.select("_row", "doc.text"), benchmark, keep=("_row",), **options).select("_row").distinct()
    return d.join(bad, "_row", "left_anti").select("doc.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`find_leaks` of all documents against all test items."""
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "word")
