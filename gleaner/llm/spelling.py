"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word, padded at both ends, has len + q - 1 positional q-grams, and one edit destroys q of them at most and moves the others by one place at most.
So two words one edit apart share at least max(len) - 1 grams (q cancels out) at positions that differ by at most one, and their
lengths differ by at most one. The lists of a word's grams, at nearby positions, of words of a nearby length, are merged by a heap; words found in as many
lists as the bound asks for are verified. Of its lists, all but the few shortest are only looked up, as a word that reaches the
bound is in one of the short ones.

Where the index lies: under any one order of all grams, such words share a gram among the q + 1 first of each. Grams go by how many words hold
them, rare ones first. A word is indexed under each of these grams and its length, and asks under the same grams
at its own length and at the one below; so each pair meets, in the part of the index of a rare gram. A part is dealt to blocks of at most BLOCK words
on average, and what is asked of it goes to each block. Nothing but verified pairs leaves a task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, cut, table

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
Q = 3
#: Code points that stand before and after a word; no word has them.
BEFORE, AFTER = "\x02", "\x03"
#: Words of a part of the index that a task holds at a time.
BLOCK = 20_000


def occurrences(docs: DataFrame, noise: int | None = 199) -> DataFrame:
    """(word): each run of letters of `docs` (doc_id, text), A-Z lower-cased; where `noise` divides h, the crc32 of `<doc_id>:<run>`, without its code point h % length. A null id is hashed as the empty text."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("w"))
    if noise is None:
        return runs.select(F.col("w").alias("word"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("w")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("w")).cast("int")
    cut_out = F.concat(F.left("w", at), F.substring("w", at + 2, F.length("w")))
    return runs.withColumn("h", h).select(F.when(F.pmod("h", F.lit(noise)) == 0, cut_out).otherwise(F.col("w")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, noise: int | None = 199) -> DataFrame:
    """(word, n) of the words of at least `min_length` code points that occur at least `min_count` times in all of `docs`."""
    words = occurrences(docs, noise).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def grams(word: str) -> list[str]:
    """The q-grams of a padded word; a gram's place in the list is its position."""
    padded = BEFORE * (Q - 1) + word + AFTER * (Q - 1)
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one word the other; equal words are not."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def near_in_block(index: list[str], asked: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(asked word, word of `index`) for those one edit apart. Words of the index have one length; of two words as long, the larger asks."""
    lists: dict[tuple[str, int], list[int]] = defaultdict(list)
    for k, w in enumerate(index):
        for p, g in enumerate(grams(w)):
            lists[g, p].append(k)
    size = len(index[0])
    sets: dict[tuple[str, int], set[int]] = {}
    for word in asked:
        bound = max(len(word), size) - 1
        found = []
        for p, g in enumerate(grams(word)):
            here = [key for key in ((g, p - 1), (g, p), (g, p + 1)) if key in lists]
            if here:
                found.append((sum(len(lists[key]) for key in here), here))
        if len(found) < bound:
            continue
        found.sort(key=lambda x: x[0])
        short, long = found[: len(found) - bound + 1], found[len(found) - bound + 1 :]
        for k, same in groupby(heapq.merge(*[lists[key] for _, here in short for key in here])):
            count = sum(1 for _ in same)
            other = index[k]
            if len(word) == size and word <= other:
                continue
            for left, (_, here) in enumerate(long):
                if count + len(long) - left < bound:
                    break
                for key in here:
                    if key not in sets:
                        sets[key] = set(lists[key])
                count += any(k in sets[key] for key in here)
            if count >= bound and one_edit(word, other):
                yield word, other


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): each pair of words one edit apart of `words` (word, each once; checkpointed), once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([g for w in batch.column(0).to_pylist() for g in set(grams(w))], pa.string())], ["g"])

    # Bounded by the alphabet: 90 letters and two pads in three places are fewer than 780,000 grams.
    counted = words.select("word").mapInArrow(split, "g string").groupBy("g").agg(F.count("*").alias("n")).collect()
    order = words.sparkSession.sparkContext.broadcast({r["g"]: (r["n"], r["g"]) for r in counted})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            keys, lengths, asks, out = [], [], [], []
            for w in batch.column(0).to_pylist():
                for g in sorted(set(grams(w)), key=rank.__getitem__)[: Q + 1]:
                    for length, ask in ((len(w), False), (len(w), True), (len(w) - 1, True)):
                        keys.append(g)
                        lengths.append(length)
                        asks.append(ask)
                        out.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lengths, pa.int32()), pa.array(asks, pa.bool_()), pa.array(out, pa.string())], ["key", "size", "asks", "word"])

    rows = words.select("word").mapInArrow(places, "key string, size int, asks boolean, word string")
    large = cut(rows.filter("NOT asks").groupBy("key", "size").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("key", "size", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    if not large.isEmpty():
        rows = rows.join(large, ["key", "size"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        block = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")))
        rows = rows.select("key", "size", F.explode(block).alias("block"), "asks", "word")
    else:
        rows = rows.select("key", "size", F.lit(0).alias("block"), "asks", "word")
    parts = rows.repartition("key", "size", "block").sortWithinPartitions("key", "size", "block", "asks")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True))
        a, b = [], []
        for _, part in groupby(stream, key=lambda r: r[:3]):
            index: list[str] = []
            first = next(part, None)
            while first is not None and not first[3]:
                index.append(first[4])
                first = next(part, None)
            if first is None or not index:
                continue
            for x, y in near_in_block(index, (r[4] for r in _again(first, part))):
                a.append(x)
                b.append(y)
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return parts.mapInArrow(merge, "a string, b string").distinct()


def _again(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached by `forms` (word, form), whose counts rise fivefold a step. Each round doubles the steps taken."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        met = cut(at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_more")))
        at = met.select("word", "root")
        if not met.agg(F.bool_or("_more")).first()[0]:
            return at


def variant_groups(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, noise: int | None = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of `vocabulary`.

    A word's form is its near word of largest n, if that is at least `ratio` times its own (ties: the smallest by code points), else null; root is the last
    word that forms lead to. n_near counts all near words. Null and empty texts have no words; repeated rows count as often as they are
    there. Other columns are ignored. An empty table gives an empty one.
    """
    words = cut(vocabulary(docs, min_length, min_count, noise))
    pairs = cut(near_words(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("_m")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.max("_m").alias("_m"))
    first = near.join(best.select(F.col("word").alias("a"), "_m"), ["a", "_m"]).groupBy(F.col("a").alias("word")).agg(F.min("b").alias("form"))
    met = words.join(best, "word", "left").join(first, "word", "left")
    taken = F.col("_m") >= ratio * F.col("n")
    met = cut(met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("_m")).alias("form_n")))
    roots = _roots(met.filter(F.col("form").isNotNull()))
    return met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`variant_groups` of all documents."""
    return variant_groups(table(spark, sf_dir, "documents"))
