"""Near copies by exact Jaccard similarity of word shingles: fingerprints, prefix filter, positional filter, exact check, components.

SimHash's grids can't carry the radius of a similarity of 0.8 (some ten bits, up to eighteen), so links of close fingerprints are
candidates beside those of a prefix filter, which misses none.

Under any one order of all shingles, two sets of similarity s or more share a shingle among the first n - ceil(s n) + 1 of each
(n: a set's own size), and where the first that they share stands at places i and j, min(n - i, m - j) reaches the overlap
that s asks for. So the candidates are exact whatever the order; it only decides how many there are. Shingles frequent
in a sample of the documents come last, the rest go by hash. With that order the shingles that prefixes hold are counted, exactly and over all
documents. Where those that more than LIMIT texts share, and that the sample hasn't put last, have more than a share of UNFORESEEN of all places in
prefixes, they come last as well, and prefixes are taken again. So a line that many unlike texts share, in whatever part of the corpus, brings none of them together.

Of a group that shares a shingle, first each is held against one, the most central: that whose prefix meets the most others, as the
original of edited copies does. What that leaves in different components is held against each other; in groups of many only texts that share a
second shingle, too, among the first n - ceil(s n) + 2 of each, as similar sets do.

Before texts are fetched, the prefixes of a pair are held against each other as a whole: they, too, must share enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.llm.common import cut, cut_counted, cut_small, join_hot
from gleaner.llm.components import connected_components
from gleaner.llm.simhash import SEED, fingerprint_links, majority, shingle_hashes

#: The order of shingles is learned from about so many documents, and remembers so many shingles at most.
SAMPLE_DOCS = 20_000
COMMON = 200_000
#: Shingles that more texts than this share in their prefixes come last; those that LIMIT times as many share come after them.
LIMIT = 64
#: See above; the result is the same either way.
UNFORESEEN = 0.005
#: Shingles over a limit are marked in a bitmap, by their hash: 16 bits for each, BITS at most. Others whose bit is marked go last with them: that is an order as good as another.
BITS = 1 << 26
#: Groups of more members than this, in different components still, share a second shingle.
MANY = 4 * LIMIT
#: Groups of more members than this meet block by block.
BLOCK = 4_096
#: So many rows (some 70 to 100 bytes each there) are broadcast at most, to pick texts or leave out copies; more are joined by a shuffle.
BROADCAST_ROWS = 250_000


def shingles(text: str | None, k: int) -> set[bytes]:
    """The distinct runs of `k` words, in lower case; all words of a text that has fewer; none of a text without a word."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _common(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes found in several documents of a sample, sorted, in how many, and the sample's share."""
    share = SAMPLE_DOCS / max(1, texts.count())
    sample = texts if share >= 1 else texts.filter(F.xxhash64(F.lit("sample"), "_row") < int((2 * share - 1) * 2**63))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), k)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], ["h"])

    counted = sample.select("text").mapInArrow(of, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows = counted.orderBy(F.col("n").desc(), "h").limit(COMMON).toArrow()
    h, n = rows.column("h").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order], min(1.0, share)


def _marks(counted: DataFrame, limits: list[int]) -> np.ndarray:
    """A bitmap for each of `limits`: the keys that `counted` (key, n) has more than so often. BITS bits each at most, whatever the number of keys."""
    n_bits = min(BITS, 1 << max(10, (16 * counted.filter(F.col("n") > min(limits)).count()).bit_length()))
    level = F.array_compact(F.array(*[F.when(F.col("n") > limit, F.lit(k)) for k, limit in enumerate(limits)]))
    at = F.pmod("key", F.lit(n_bits))
    words = counted.filter(F.col("n") > min(limits)).select(F.explode(level).alias("level"), F.shiftright(at, 6).cast("int").alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = words.groupBy("level", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # BITS / 64 rows for each limit at most
    out = np.zeros((len(limits), n_bits // 64), np.uint64)
    out[rows.column("level").to_numpy(), rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many of the bitmaps have each hash."""
    at = (h & np.uint64(64 * marks.shape[1] - 1)).astype(np.int64)
    return ((marks[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).sum(axis=0).astype(np.int64)


def prefixes(texts: DataFrame, k: int, similarity: float, common: Broadcast, marks: Broadcast | None = None) -> DataFrame:
    """_row, doc_id, fp (the fingerprint), id (128 bits of the whole set), n (its size) and keys (its prefix and one more, in order) for each row of `texts`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count, share = common.value
        level = (count / share > LIMIT).astype(np.int64) + (count / share > LIMIT * LIMIT)
        for batch in batches:
            fps, ids, sizes, keys = [], [], [], []
            for t in batch.column(2):
                h = shingle_hashes(t.as_py(), k)
                fps.append(majority(h) if len(h) else 0)
                h = np.unique(h)
                rank, over = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
                    known = seen[at] == h
                    rank, over = np.where(known, count[at], 0), np.where(known, level[at], 0)
                if marks is not None:  # what the sample says and what was counted in prefixes, which hold few of what the sample has put last
                    over = np.maximum(over, _marked(marks.value, h))
                rank += over << 40
                ids.append(xxhash.xxh3_128_digest(h.tobytes(), SEED))
                sizes.append(len(h))
                keys.append(h[np.lexsort((h, rank))[: prefix_size(len(h), similarity) + 1]].view(np.int64))
            flat = np.concatenate([*keys, np.empty(0, np.int64)])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            cols = [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(cols, ["_row", "doc_id", "fp", "id", "n", "keys"])

    return texts.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "_row binary, doc_id bigint, fp bigint, id binary, n int, keys array<bigint>")


def _unforeseen(counts: DataFrame, common: Broadcast) -> int:
    """How many places in prefixes the keys of `counts` (key, n) have that more than LIMIT texts share and that the sample didn't put last."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count, share = common.value
        last = seen[count / share > LIMIT]
        for batch in batches:
            new = ~np.isin(batch.column("key").to_numpy().view(np.uint64), last)
            yield pa.RecordBatch.from_arrays([pa.array([int(batch.column("n").to_numpy()[new].sum())], pa.int64())], ["n"])

    hot = counts.filter(F.col("n") > LIMIT).select("key", "n").mapInArrow(of, "n bigint")
    return hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _sets(texts: DataFrame, k: int, similarity: float, common: Broadcast, marks: Broadcast | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """The prefixes of `texts`; one (id, number, _row, fp, n), a row for each set; sets (id: the number, n, keys); counts (key, n) of the keys that several sets have in their prefixes; and how many places all prefixes have."""
    seen = Observation()
    d = prefixes(texts, k, similarity, common, marks).observe(seen, F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("places"))
    d = cut(d).withColumn("_u", F.monotonically_increasing_id())  # of a checkpointed table: the same whenever it is read
    one = cut_small(d.groupBy("id").agg(F.min("_u").alias("number"), F.min_by("_row", "_u").alias("_row"), F.min("fp").alias("fp"), F.count("*").alias("n")))
    several = one.filter("n > 1")
    again, n_again = cut_counted(join_hot(d.select("id", "_u"), several.select("id", "number"), "id", several.select("id", "n")).filter("_u != number").select("_u"))
    few = n_again <= BROADCAST_ROWS  # copies are left out by a broadcast, not sets picked by one: these are nearly all
    sets = d.join(F.broadcast(again) if few else again, "_u", "left_anti").select(F.col("_u").alias("id"), "n", "keys")
    sets = sets if few else cut(sets)
    inside = F.slice("keys", F.lit(1), F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1)
    counts = cut_small(sets.select(F.explode(inside).alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    return d, one, sets, counts, seen.get["places"]


def _may(n: Column, rest: Column, m: Column, other: Column, similarity: float) -> Column:
    """Whether sets of `n` and `m` shingles can still overlap enough, with `rest` and `other` of them from a shared one on."""
    return F.least(rest, other) >= F.lit(similarity / (1 + similarity)) * (n + m) - F.lit(1e-6)


def _close_prefixes(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b) of ids of `sets` (id, n, keys) that may have that similarity by all keys they share among the first of each.

    Of what two sets share, all but what one of them has after its own first keys is among the first keys of both; and after the last key that both have there, each has so many left.
    """
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("_n"), F.col("keys").alias("_s")), "a").join(sets.select(F.col("id").alias("b"), F.col("n").alias("_m"), F.col("keys").alias("_t")), "b")
    met = met.withColumn("_both", F.array_intersect("_s", "_t")).withColumn("_last", F.try_element_at("_both", F.lit(-1)))
    left = F.least(F.col("_n") - F.array_position("_s", F.col("_last")), F.col("_m") - F.array_position("_t", F.col("_last")))
    most = F.size("_both") + F.least(F.greatest(F.col("_n") - F.size("_s"), F.col("_m") - F.size("_t")), F.coalesce(left, F.lit(0)))
    return met.filter(most >= F.lit(similarity / (1 + similarity)) * (F.col("_n") + F.col("_m")) - F.lit(1e-6)).select("a", "b")


def verified(pairs: DataFrame, one: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The `pairs` (a, b) of ids whose texts have that similarity, by their shingles themselves; `one` (id, _row) names a row of `texts` for each id."""
    rows, n = cut_counted(one.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "_row"))
    t = texts.select("_row", "text").join(F.broadcast(rows) if n <= BROADCAST_ROWS else rows, "_row").dropDuplicates(["id"]).select("id", "text")
    # The pivot of a large group is in a pair with each of it. Texts are cut, so that both sides are plain shuffles and AQE splits such a partition.
    t = cut(t)
    met = pairs.join(t.select(F.col("id").alias("a"), F.col("text").alias("_s")), "a").join(t.select(F.col("id").alias("b"), F.col("text").alias("_t")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingles(s.as_py(), k), shingles(t.as_py(), k)
                both = len(x & y)
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "_s", "_t").mapInArrow(check, "a bigint, b bigint")


def _met_in_blocks(m: DataFrame, on: list[str], groups: DataFrame, similarity: float, block: int) -> DataFrame:
    """Candidate pairs (a, b) of rows of `m` (on, id, n, rest, root) with different roots in the same of `groups` (on, n), block by block."""
    m = join_hot(m, groups.select(*on, F.ceil(F.col("n") / block).cast("int").alias("_blocks")), on, groups)
    m = m.withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    left = m.withColumn("_j", F.explode(others)).select(*on, "_i", "_j", F.col("id").alias("a"), F.col("n").alias("_n"), F.col("rest").alias("_r"), F.col("root").alias("_ra"))
    right = m.withColumnRenamed("_i", "_j").withColumn("_i", F.explode(others)).select(*on, "_i", "_j", F.col("id").alias("b"), F.col("n").alias("_m"), F.col("rest").alias("_q"), F.col("root").alias("_rb"))
    near = (F.col("a") < F.col("b")) & (F.col("_ra") != F.col("_rb")) & _may(F.col("_n"), F.col("_r"), F.col("_m"), F.col("_q"), similarity)
    return left.join(right, [*on, "_i", "_j"]).filter(near).select("a", "b")


def _unresolved(met: DataFrame, keys: DataFrame, roots: DataFrame, similarity: float, block: int) -> DataFrame:
    """Candidate pairs (a, b) of `met` in different components, but for those with the pivot of a group.

    In groups of over MANY members they share a second key of `keys` (id, keys) after the first, too: so similar sets do.
    """
    m = met.join(roots, met["id"] == roots["node"], "left").select("key", "id", "n", "rest", "pivot", F.coalesce("root", "id").alias("root"))
    apart = lambda df, on: df.groupBy(*on).agg(F.min("root").alias("_x"), F.max("root").alias("_y"), F.count("*").alias("n")).filter("_x != _y").select(*on, "n")
    open_ = cut_small(apart(m, ["key"]).filter("n > 2"))
    m = m.filter(F.col("id") != F.col("pivot")).drop("pivot")
    few, many = (open_.filter(F.col("n") <= MANY), open_.filter(F.col("n") > MANY))
    pairs = _met_in_blocks(m, ["key"], few, similarity, block)
    if not many.isEmpty():
        m = join_hot(m, many.select("key"), "key", many)
        later = F.slice("keys", F.array_position("keys", F.col("key")).cast("int") + 1, F.size("keys"))
        m = cut_small(m.join(keys, "id").select("key", F.explode(later).alias("next"), "id", "n", "rest", "root"))
        pairs = pairs.union(_met_in_blocks(m, ["key", "next"], cut_small(apart(m, ["key", "next"])), similarity, block))
    return pairs.distinct()


def _fingerprint_pairs(ids: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) of `ids` (id, fp) that join whatever has fingerprints within `max_bits` bits: equal ones by their least id."""
    least = cut_small(ids.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    same = ids.join(least.filter("n > 1").select("fp", "least"), "fp").filter("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}"))
    links = fingerprint_links(least.select("fp"), max_bits)
    return same.union(links.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _shared_keys(sets: DataFrame, similarity: float, counts: DataFrame) -> DataFrame:
    """key, id, n and rest of the prefixes of `sets` (id, n, keys) for keys that `counts` (key, n) may have: a bitmap of them leaves out nearly all others before anything is shuffled."""
    shared = sets.sparkSession.sparkContext.broadcast(_marks(counts, [1]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            found, rest, which = [], [], []
            for i, keys in enumerate(batch.column("keys")):
                h = keys.values.to_numpy()[: prefix_size(int(sizes[i]), similarity)]
                at = np.flatnonzero(_marked(shared.value, h.view(np.uint64)))
                found.append(h[at])
                rest.append(sizes[i] - at)
                which.append(np.full(len(at), i))
            row = pa.array(np.concatenate([*which, np.empty(0, np.int64)]).astype(np.int64))
            cols = [pa.array(np.concatenate([*found, np.empty(0, np.int64)])), batch.column("id").take(row), batch.column("n").take(row), pa.array(np.concatenate([*rest, np.empty(0, np.int64)]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "id", "n", "rest"])

    return sets.select("id", "n", "keys").mapInArrow(of, "key bigint, id bigint, n int, rest int")


def similar_components(texts: DataFrame, k: int, similarity: float, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """_row, doc_id and root, alike for rows of `texts` (_row, doc_id, text) that links of `similarity` or more connect."""
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(_common(texts, k))
    d, one, sets, counts, places = _sets(texts, k, similarity, common, None)
    if _unforeseen(counts, common) > UNFORESEEN * places:
        marks = spark.sparkContext.broadcast(_marks(counts, [LIMIT, LIMIT * LIMIT]))
        d, one, sets, counts, _ = _sets(texts, k, similarity, common, marks)
    ids = one.select(F.col("number").alias("id"), "_row", "fp")
    met = cut_small(join_hot(_shared_keys(sets, similarity, counts), counts.select("key", F.col("n").alias("_c")), "key", counts))
    central = met.groupBy("id").agg(F.sum("_c").alias("_s"))
    pivot = met.join(central, "id").groupBy("key").agg(F.max(F.struct("_s", "id", "n", "rest")).alias("_l"))
    pivot = cut_small(pivot.select("key", F.col("_l.id").alias("pivot"), F.col("_l.n").alias("_ln"), F.col("_l.rest").alias("_lr")))
    met = cut_small(join_hot(met.drop("_c"), pivot, "key", counts))
    stars = met.filter((F.col("id") != F.col("pivot")) & _may(F.col("n"), F.col("rest"), F.col("_ln"), F.col("_lr"), similarity)).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    close = _fingerprint_pairs(ids.select("id", "fp"), max_bits)
    pairs = stars.union(close).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    near = lambda p: cut_small(verified(cut_small(_close_prefixes(p, sets, similarity)), ids, texts, k, similarity))
    first = near(pairs)
    roots = connected_components(first)
    more = near(_unresolved(met, sets.select("id", "keys"), roots, similarity, block))
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    rooted = one.join(roots, one["number"] == roots["node"], "left").select("id", F.coalesce("root", "number").alias("root"))
    return join_hot(d.select("_row", "doc_id", "id"), rooted, "id", one.select("id", "n")).select("_row", "doc_id", "root")
