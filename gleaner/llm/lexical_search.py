"""Ranked search by TPUT (three-phase uniform threshold) over postings kept by term.

A document's score for an item is a sum over the item's terms of what its postings give it, all in 64-bit integers:
w * ((10^9 tf) div (1000 tf + 20 m)), with w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 50 + (50 n N) div L.

1. The head of each list, its k largest postings, gives partial sums; an item's k-th largest partial sum, tau, is a lower bound of its k-th best score.
2. From every list of an item of q terms all postings of tau / q or more are fetched: a document with none is below tau. The k-th
   largest of these sums is a better bound. What a list may still hide from a document is its largest posting below the threshold (none, if all
   were fetched); a document whose sum and hidden parts don't reach the bound is out.
3. The postings of the documents left are looked up in all lists; the exact sums are ranked.

Lists are kept in one table, dealt by term. Those of common terms are dealt by document, so no task holds one of them, and what a
document gets from them is added up before anything is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_ROWS, HOT_PARTS, UPPER, cut, join_hot, new_folder, sized, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Each byte of UTF-8: A-Z in lower case, what is in no term a space.
_BYTES = bytes(ord(c) if TERM.match(c := chr(k).lower()) else 32 for k in range(128)) + bytes(range(128, 256))


def _terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return (text or b"").translate(_BYTES).split()


def terms(text: str | None) -> list[str]:
    """The terms of a text, in order, with repeats: runs of digits, letters and all that isn't ASCII; only A-Z are lower-cased."""
    return [t.decode() for t in _terms((text or "").encode())]


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): a row for each distinct term of each distinct row of `items` (item_id, text); item numbers the rows."""
    rows = items.select("item_id", F.col("text").alias("_t")).distinct().select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.coalesce("_t", F.lit("")).alias("_t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t.as_py()))) for t in batch.column(2)]
            at = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([t for f in found for t in f], pa.string())], ["item", "item_id", "term"])

    return rows.mapInArrow(split, f"item bigint, item_id {rows.schema['item_id'].dataType.simpleString()}, term string")


def _known(wanted: DataFrame) -> set[bytes] | None:
    """The terms of a checkpointed table, if they are few enough to be broadcast; those of others are joined later."""
    return {r[0].encode() for r in wanted.collect()} if wanted.count() <= BROADCAST_ROWS else None


def term_counts(docs: DataFrame, wanted: DataFrame) -> tuple[int, int, DataFrame]:
    """N (documents with a term), L (all terms) and (term, df) of the `wanted` terms (checkpointed) over all of `docs` (text)."""
    known = docs.sparkSession.sparkContext.broadcast(_known(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value
        for batch in batches:
            df: Counter[bytes] = Counter()
            n = total = 0
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                found = _terms(t)
                n, total = n + bool(found), total + len(found)
                df.update(set(found) if keep is None else keep.intersection(found))
            yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()).cast(pa.string()), pa.array([n, *df.values()], pa.int64()), pa.array([total] + [0] * len(df), pa.int64())], ["term", "n", "total"])

    counts = docs.select("text").mapInArrow(count, "term string, n bigint, total bigint")
    if known.value is None:
        counts = counts.filter(F.col("term").isNull()).unionByName(sized(counts, wanted, "term", "left_semi"))
    counts = cut(counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    whole = counts.filter(F.col("term").isNull()).select("n", "total").first() or (0, 0)
    return whole[0], whole[1], counts.filter(F.col("term").isNotNull()).select("term", F.col("n").alias("df"))


@dataclass
class Index:
    """Postings (row, doc_id, term, c), c being what one adds to a score, and (term, df); row numbers the documents."""

    postings: DataFrame
    df: DataFrame


def build_index(docs: DataFrame, wanted: DataFrame) -> Index:
    """The postings of the `wanted` terms (term; checkpointed) in all of `docs` (doc_id, text), written once; those that add nothing are left out."""
    spark = docs.sparkSession
    n_docs, n_terms, df = term_counts(docs, wanted)
    known = spark.sparkContext.broadcast(_known(wanted))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value
        for batch in batches:
            sizes, found_in, found, tfs = [], [], [], []
            for i, t in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                words = _terms(t)
                sizes.append(len(words))
                tf = Counter(words if keep is None else filter(keep.__contains__, words))
                found_in += [i] * len(tf)
                found += tf
                tfs += tf.values()
            at = pa.array(found_in, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes, pa.int64()).take(at), pa.array(found, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], ["row", "doc_id", "n", "term", "tf"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, "row bigint, doc_id bigint, n bigint, term string, tf bigint")
    total = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    w = cut(df.select("term", F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"), (F.col("df") > max(1, total // HOT_PARTS)).alias("hot")))
    met = sized(rows, w, "term", "inner") if known.value is not None else join_hot(rows, w, "term", df.withColumnRenamed("df", "n"))
    c = met.withColumn("m", F.expr(f"50 + (50 * n * {n_docs}L) div {max(1, n_terms)}L")).withColumn("c", F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))")).filter("c > 0")
    dealt = c.repartition(F.when(F.col("hot"), F.xxhash64("row")).otherwise(F.xxhash64("term")))
    folder = new_folder(spark, "postings")
    dealt.select("row", "doc_id", "term", "c").sortWithinPartitions("term", F.desc("c")).write.parquet(folder)
    return Index(spark.read.parquet(folder), df)


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """(item, name): the k-th largest s of each item of `sums` (item, row, s and others); items with fewer rows have none."""
    # All columns are in the order, so that none is pruned and the shuffle of `sums` is the one that its other users read.
    ranked = sums.select("item", "s", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"), *[c for c in sums.columns if c not in ("item", "s")])).alias("_n")).filter(F.col("_n") <= k)
    return ranked.filter(F.col("_n") == k).select("item", F.col("s").alias(name))


def _lists(index: Index, query: DataFrame) -> DataFrame:
    """Postings beside the rows of `query` (item, term and others; checkpointed) that have their term."""
    return index.postings.join(F.broadcast(query), "term") if query.count() <= BROADCAST_ROWS else join_hot(index.postings, query, "term", index.df.withColumnRenamed("df", "n"))


def top_documents(index: Index, query: DataFrame, k: int) -> DataFrame:
    """(item, row, doc_id, score, rank) of the k best documents of each item of `query` (item, term); equal scores by ascending doc_id, null ids first."""
    best = Window.partitionBy("term").orderBy(F.desc("c"), "row")
    heads = cut(index.postings.select("term", "row", "c", F.row_number().over(best).alias("_n")).filter(F.col("_n") <= k).drop("_n"))
    query = cut(sized(query.select("item", "term"), cut(index.df.select("term")), "term", "left_semi"))
    tau = _kth(heads.join(query, "term").groupBy("item", "row").agg(F.sum("c").alias("s")), k, "tau")
    limits = query.groupBy("item").agg(F.count("*").alias("q")).join(tau, "item", "left")
    limits = limits.select("item", F.greatest(F.lit(1), F.ceil(F.coalesce("tau", F.lit(0)) / F.col("q"))).cast("long").alias("t"))
    query = cut(query.join(limits, "item"))
    # What lists hide: of each list only what is below the highest threshold of any item that has the term.
    most = cut(query.groupBy("term").agg(F.max("t").alias("_t")).filter("_t > 1"))
    below = sized(index.postings, most, "term", "inner").filter(F.col("c") < F.col("_t")).groupBy("term", "c").agg(F.lit(1).alias("_1")).select("term", "c")
    hidden = below.join(query, "term").filter(F.col("c") < F.col("t")).groupBy("item", "term").agg(F.max("c").alias("u"))
    query = cut(query.join(hidden, ["item", "term"], "left").select("item", "term", "t", F.coalesce("u", F.lit(0)).alias("u")))
    fetched = _lists(index, query).filter(F.col("c") >= F.col("t"))
    sums = fetched.groupBy("item", "row").agg(F.sum("c").alias("s"), F.sum(F.col("c") - F.col("u")).alias("v"))
    bound = query.groupBy("item").agg(F.sum("u").alias("_hidden")).join(_kth(sums, k, "tau"), "item", "left")
    # s, too, is looked at on either side of this join, so that both read one shuffle.
    left = cut(sums.filter("s > 0").join(bound, "item").filter(F.col("v") + F.col("_hidden") >= F.coalesce("tau", F.lit(0))).select("item", "row"))
    exact = sized(index.postings, left, "row", "inner").join(query.select("item", "term"), ["item", "term"])
    scores = exact.groupBy("item", "row").agg(F.sum("c").alias("score"), F.first("doc_id").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of `docs` (doc_id, text) for each row of `items` (item_id, text), of those with a score above 0.

    Null and empty texts have no term: such documents are never found, such items find nothing. Rows alike in id and text are an item
    together; rows that share an id only are items of their own under it. Rows that repeat a doc_id are documents of their own. Equal scores go by
    ascending doc_id, null ids first. Other columns are ignored. Empty tables give an empty one.
    """
    query = cut(item_terms(items))
    index = build_index(docs, cut(query.select("term").distinct()))
    names = cut(query.select("item", "item_id").distinct())
    found = sized(top_documents(index, query, k), names, "item", "inner")
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ranked_search` of every item of benchmark over all documents."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM.pattern}')"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
c AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_terms)))) AS c FROM p JOIN w USING (term), s),
f AS (SELECT item_id, r, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY ALL HAVING sum(c) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM f QUALIFY rank <= 50"""
