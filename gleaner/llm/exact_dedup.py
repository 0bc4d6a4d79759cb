"""Exact dedup by a content sort: sampled splitters deal texts to ranges, each range is sorted, neighbours are compared in full.

The order is: the first HEAD code points of a text, the SHA-256 of all of it, its id downwards. The head keeps ranges in order of content; the digest
parts texts with a long common beginning, and bounds what is sampled for the splitters (a sample of whole texts would pass through the driver);
the id lets a splitter fall within a group of copies, so a group of any size is spread over as many ranges as it needs.
Spark's own external sort sorts a range. A run is a stretch of equal neighbours in a range, found by comparing texts themselves.

A group that a splitter parts is a chain of runs at the edges of ranges: the first and the last run of each range keep
their text, the last one of a range is compared in full with the first of the next, and what chains add is joined back. There are two such runs in
a range at most, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import new_folder, table

#: Code points of a text that lead the order.
HEAD = 64
_ROWS = "doc_id bigint, sha binary, part int, run bigint, keep bigint, n bigint, first boolean, edge string, text string"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_ROWS of a sorted range (doc_id, sha, text): a row for each of its documents, once their run has ended, and edge rows with the texts of its first and last run.

    What is held is the text of the run at hand and the ids of its documents, eight bytes each of the rows of one range.
    """
    part = TaskContext.get().partitionId()
    text: str | None = None
    sha, ids, run, first_edge = b"", [], 0, None

    def members() -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([sha] * n, pa.binary()), pa.array([part] * n, pa.int32()), pa.array([run] * n, pa.int64()), pa.array([ids[0]] * n, pa.int64()),
             pa.array([n] * n, pa.int64()), pa.array([i == 0 for i in range(n)]), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=_NAMES)

    def edge(side: str) -> pa.RecordBatch:
        row = dict(zip(_NAMES, (None, None, part, run, ids[0], len(ids), None, side, text), strict=True))
        return pa.RecordBatch.from_pylist([row], pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("part", pa.int32()), ("run", pa.int64()), ("keep", pa.int64()), ("n", pa.int64()), ("first", pa.bool_()), ("edge", pa.string()), ("text", pa.string())]))

    done: list[pa.RecordBatch] = []
    for batch in batches:
        texts = batch.column(2)
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            here = texts[i].as_py()
            if here == text:
                ids.append(doc_id)
                continue
            if text is not None:
                done.append(members())
                if first_edge is None:
                    first_edge = edge("first")
                    done.append(first_edge)
                if sum(x.num_rows for x in done) >= 10_000:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done = []
                run += 1
            text, sha, ids = here, batch.column(1)[i].as_py(), [doc_id]
    if text is not None:
        done += [members(), edge("only" if first_edge is None else "last")]
    yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()


def _chains(edges: DataFrame) -> DataFrame:
    """(part, run, _keep, _n, _starts) of the runs at the edges of ranges: the first id and the size of the chain each is of, and whether it begins it."""
    e = edges.select("part", "run", "keep", "n", "edge")
    along = Window.orderBy("part")  # a row for each range that has rows
    ranks = e.select("part").distinct().withColumn("rank", F.row_number().over(along))
    text = edges.select("part", "edge", "text").join(F.broadcast(ranks), "part")
    left = text.filter(F.col("edge") != "first").select((F.col("rank") + 1).alias("rank"), F.col("text").alias("_t"))
    right = text.filter(F.col("edge") != "last").select("rank", "part", "text")
    goes_on = right.join(left, "rank").filter(F.col("text") == F.col("_t")).select("part", F.lit(True).alias("_on"))
    ordered = Window.orderBy("part", "run")  # two rows for each range at most
    e = e.join(F.broadcast(goes_on), "part", "left").withColumn("_starts", ~(F.coalesce("_on", F.lit(False)) & (F.col("edge") != "last")))
    e = e.withColumn("_chain", F.sum(F.col("_starts").cast("long")).over(ordered))
    chain = e.groupBy("_chain").agg(F.max("keep").alias("_keep"), F.sum("n").alias("_n"))
    return e.join(chain, "_chain").select("part", "run", "_keep", "_n", "_starts")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows with equal texts, to the byte, are a group; null counts as the empty text. The row with the largest doc_id stays
    (null ids are below all; of rows alike in id and text one stays), keep_id is its id. Other columns are ignored. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    order = [F.left("text", F.lit(HEAD)), F.col("sha"), F.desc_nulls_last("doc_id")]
    folder = new_folder(docs.sparkSession, "exact-dedup")
    d.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, _ROWS).write.parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    chains = _chains(rows.filter(F.col("edge").isNotNull()))
    met = rows.filter(F.col("edge").isNull()).join(F.broadcast(chains), ["part", "run"], "left")  # two rows for each range at most
    return met.select(
        "doc_id", F.when(F.col("_n").isNull(), F.col("keep")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_n", "n").alias("group_size"),
        (F.col("first") & F.coalesce("_starts", F.lit(True))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text and others) that `duplicate_groups` keeps. Rows that repeat an id and a text need another column's value to be told apart: all of them stay."""
    kept = duplicate_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha")).distinct()
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (sha == F.col("_sha")), "left_semi")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`duplicate_groups` of all documents."""
    return duplicate_groups(table(spark, sf_dir, "documents"))


OP13_SQL = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
