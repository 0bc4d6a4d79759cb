"""SimHash near-dedup: fingerprints whose segment bit counts lie close are verified and linked.

The range join. A fingerprint's embedding is the vector of bit counts of its 32 segments of 2 bits.
The Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so
links have vectors within `max_bits`. The segments form `bands`; at most `max_bits` bands can differ,
hence two linked vectors agree in all other bands. For each choice of bands - max_bits of them, the vectors
projected on these bands make a grid of unit cells, and two linked vectors share a cell of some grid.
Within cells, Manhattan distance of the 8 byte counts, then Hamming distance, decide. Cells are counted
before; the fingerprints of those with too many for a task meet at centres instead (`ball_links`), which is exact too.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut, join_hot, row_key, table
from gleaner.llm.components import connected_components

SEED = 42
PAIRS = 0x5555555555555555
#: Cells with more points than this are searched outwards from a point instead of pair by pair.
SMALL_CELL = 48
#: Cells with more points than this are no task's work; their points meet at centres.
LARGE_CELL = 1 << 16
#: About so many rows of cells go to a task at most.
ROWS_IN_TASK = 8_000_000
#: So many large cells (8 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000


def fingerprint(text: str | None, words_in_shingle: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is 1 if set in over half the shingles' hashes."""
    return majority(hashes) if len(hashes := shingle_hashes(text, words_in_shingle)) else 0


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def shingle_hashes(text: str | None, words_in_shingle: int) -> np.ndarray:
    """XXH64 of each shingle in turn, repeats included; none of a text without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - words_in_shingle + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[min(words_in_shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprints(docs: DataFrame, words_in_shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """fp beside the columns `keep`, integers or binary, for each row of `docs` (text)."""
    kinds = {c: "binary" if docs.schema[c].dataType.simpleString() == "binary" else "bigint" for c in keep}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t.as_py(), words_in_shingle) for t in batch.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], fp], [*keep, "fp"])

    whole = docs.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keep], F.col("text").alias("_text"))
    return whole.mapInArrow(of, ", ".join(f"{c} {kind}" for c, kind in (kinds | {"fp": "bigint"}).items()))


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 segments, 2 bits each."""
    above, low = F.shiftrightunsigned(fp, 1), F.lit(PAIRS)
    return fp.bitwiseXOR(above).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(above).bitwiseAND(low), 1))


def bands_for(n: int) -> int:
    """So many bands that chance cell mates stay few for `n` fingerprints."""
    return 8 if n <= 16_000_000 else 10 if n <= 1_000_000_000 else 12


def cell_masks(bands: int, max_bits: int) -> list[int]:
    """For each grid, the mask of the bands that it is projected on, as a signed 64-bit integer."""
    edge = [round(32 * k / bands) * 2 for k in range(bands + 1)]
    band = [((1 << edge[k + 1]) - (1 << edge[k])) for k in range(bands)]
    masks = [sum(x) for x in itertools.combinations(band, bands - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are linked: first by the lower bound, then exactly."""
    ca = np.bitwise_count(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)).astype(np.int8)
    cb = np.bitwise_count(np.ascontiguousarray(b).view(np.uint8).reshape(-1, 8)).astype(np.int8)
    near = np.abs(ca - cb).sum(axis=1) <= max_bits
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= max_bits
    return near


def _forest(points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all linked points of one large cell: a search outwards that only looks at points not yet reached."""
    left, a, b = points, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            p = todo.pop()
            hit = np.bitwise_count(left ^ p) <= max_bits
            found, left = left[hit], left[~hit]
            a.append(np.full(len(found), p))
            b.append(found)
            todo.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (points[:0], points[:0])


def link_cells(cells: np.ndarray, points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among points (uint64) that share a cell; both arrays are sorted by cell."""
    cuts = np.flatnonzero(np.diff(cells)) + 1
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cells)]])
    sizes = stops - starts
    a, b = [], []
    for s, e in zip(starts[sizes > SMALL_CELL], stops[sizes > SMALL_CELL], strict=True):
        x, y = _forest(points[s:e], max_bits)
        a.append(x)
        b.append(y)
    few = np.repeat((sizes > 1) & (sizes <= SMALL_CELL), sizes)
    c, p = cells[few], points[few]
    for lag in range(1, SMALL_CELL):
        at = np.flatnonzero(c[lag:] == c[:-lag])
        if not len(at):
            break
        at = at[_close(p[at], p[at + lag], max_bits)]
        a.append(p[at])
        b.append(p[at + lag])
    return (np.concatenate(a), np.concatenate(b)) if a else (points[:0], points[:0])


def _ball(radius: int) -> np.ndarray:
    """The 64-bit masks of at most `radius` bits."""
    bits = [1 << k for k in range(64)]
    return np.array([sum(x) for r in range(radius + 1) for x in itertools.combinations(bits, r)], np.uint64)


def ball_links(points: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) that join whatever fingerprints of `points` (fp, each once) are within `max_bits` bits.

    Two fingerprints are so if and only if some 64-bit number, a centre, is within half of `max_bits` (rounded down) of one and
    within the rest of it of the other. At each centre, the points within the rest are linked to the least of those within
    the half. Each point goes to 2,081 centres (for 4 bits), and no more than that meet at one, however many lie close.
    """
    masks = _ball((max_bits + 1) // 2)
    inner = np.bitwise_count(masks) <= max_bits // 2

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(fp), 64):
                p = fp[k : k + 64]
                cols = [np.repeat(p, len(masks)).view(np.int64), (p[:, None] ^ masks).ravel().view(np.int64), np.tile(inner, len(p))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["fp", "centre", "inner"])

    met = points.select("fp").mapInArrow(centres, "fp bigint, centre bigint, inner boolean")
    least = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("centre"))
    return met.withColumn("_least", least).filter(F.col("fp") != F.col("_least")).select(F.col("fp").alias("a"), F.col("_least").alias("b"))


def fingerprint_links(distinct: DataFrame, max_bits: int = 4, bands: int | None = None, large_cell: int = LARGE_CELL) -> DataFrame:
    """Edges (a, b) between fingerprints of `distinct` (fp, each once) that join whatever is within `max_bits` bits.

    Not every pair: in a cell of many points, enough edges that all linked points are connected. Rows grow as the
    fingerprints do. Copies have one fingerprint and are gone before; a cell holds distinct fingerprints only.
    Cells of more than `large_cell` points are left to `ball_links`, so no task holds more points than that at once.
    """
    n_points = distinct.count()
    masks = cell_masks(bands or bands_for(n_points), max_bits)
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_points * len(masks) // ROWS_IN_TASK))
    v = segment_counts(F.col("fp"))
    keys = F.array(*[F.xxhash64(F.lit(k), v.bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    cells = distinct.select("fp", F.explode(keys).alias("cell"))
    large = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > large_cell).select("cell"))
    n_large = large.count()
    beyond = None
    if n_large:
        large = F.broadcast(large) if n_large <= BROADCAST_CELLS else large
        beyond = ball_links(cells.join(large, "cell", "left_semi").select("fp").distinct(), max_bits)
        cells = cells.join(large, "cell", "left_anti").select("fp", "cell")
    cells = cells.repartition(n, "cell").sortWithinPartitions("cell")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_p = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                c, p, held_c = held_c, held_p, held_c[:0]
            else:
                c = np.concatenate([held_c, batch.column("cell").to_numpy()])
                p = np.concatenate([held_p, batch.column("fp").to_numpy().view(np.uint64)])
                k = int(np.searchsorted(c, c[-1])) if len(c) else 0  # the last cell may go on
                held_c, held_p, c, p = c[k:], p[k:], c[:k], p[:k]
            if len(c):
                a, b = link_cells(c, p, max_bits)
                if len(a):
                    e = np.unique(np.stack([a, b], axis=1).view(np.int64), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    edges = cells.select("cell", "fp").mapInArrow(link, "a bigint, b bigint")
    return edges if beyond is None else edges.union(beyond)


def simhash_components(docs: DataFrame, max_bits: int = 4, words_in_shingle: int = 4, bands: int | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): the columns `keep` (integers or binary; doc_id among them), fp, component_id, root.

    component_id is the smallest doc_id that links reach, its own included; null ids are passed over
    (null where a component has no other); root is the component's least fingerprint. Null texts and texts without a word have fingerprint
    zero and are linked like any other. Repeated rows are linked as copies. Other columns are ignored.
    """
    d = cut(fingerprints(docs, words_in_shingle, keep))
    classes = cut(d.groupBy("fp").agg(F.min("doc_id").alias("_least"), F.count("*").alias("n")))
    roots = connected_components(fingerprint_links(classes.select("fp"), max_bits, bands))
    rooted = cut(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("_least").alias("component_id"), F.count("*").alias("n")))
    parts = join_hot(rooted.select("fp", "root"), least.select("root", "component_id"), "root", least)
    return join_hot(d, parts, "fp", classes).select(*keep, "fp", "component_id", "root")


def without_near_copies(docs: DataFrame, max_bits: int = 4, words_in_shingle: int = 4, similarity: float | None = None) -> DataFrame:
    """The rows of `docs` (doc_id, text and others) that stand first in their component: one of each.

    First is the smallest doc_id, null ids last; among rows that share it, the least 128-bit hash of id and text; of wholly
    repeated rows any one. Null texts and texts without a word are copies of each other.

    With a `similarity`, texts are linked whose sets of shingles have that Jaccard similarity or more: links of fingerprints are
    verified by it, and those that lie further apart than `max_bits` are found by `shingle_join`.
    """
    from gleaner.llm.shingle_join import similar_components

    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))  # so that no column of theirs can clash
    d = whole.withColumn("_row", row_key(F.col("doc.doc_id"), F.col("doc.text")))
    texts = d.select("_row", "doc.doc_id", "doc.text")
    if similarity is None:
        parts = simhash_components(texts, max_bits, words_in_shingle, keep=("doc_id", "_row"))
    else:
        parts = similar_components(texts, words_in_shingle, similarity, max_bits)
    first = parts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first"))
    first = first.select(F.col("_first._row").alias("_row")).distinct()
    return d.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select("doc.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`simhash_components` of all documents, fingerprints in hexadecimal digits."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
