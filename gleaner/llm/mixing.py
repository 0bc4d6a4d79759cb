"""Mixing sources to target weights: exact word budgets for each source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import SPACE, WORD, cut, n_words, table


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """Targets of a table (source, source_size): the columns of `sizes` and target.

    Sources, by code point and null last, weigh `weights` in turn. They divide `share` of all words by
    weight; none gets more than `max_epochs` times its size, and what is over goes to the others by
    weight until none is above. That level is max over k of (total - caps before k) / (weights from k),
    with the sources in order of cap / weight. There is a row for each source: a recipe that one task holds.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    return (
        weighed.withColumn("_level", level)
        .withColumn("target", F.round(F.least(F.col("_cap"), F.max("_level").over(whole) * F.col("_w")), 6))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, rows_per_bucket: int = 20_000) -> DataFrame:
    """How many words of each document the mix takes.

    `docs` has doc_id, source and size (words) and may have other columns, which are ignored. Returns a row
    for each row: doc_id, source, size, source_size, target (of its source) and taken.
    Within a source, documents stand in the order of the md5 of (doc_id, size), a random key that
    any run repeats; null ids and ties fall back on doc_id and size. A source with budget b and size s is
    taken b div s times in full, then up to the word b mod s, so the last document may be cut.
    Empty documents take 0. An empty table gives an empty one.

    Keys are dealt to buckets by their leading bits. Sums within a bucket and over a source's buckets
    make the prefix sums, so a source with a third of all rows is no task of its own.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    d = cut(docs.select("doc_id", "source", F.col("size").cast("long").alias("size")))
    bits = max(0, min(31, math.ceil(math.log2(max(1, d.count()) / rows_per_bucket))))
    d = d.withColumn("_key", key).withColumn("_bucket", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 32 - bits))
    d = d.withColumn("_src", F.coalesce(F.col("source"), F.lit(""))).withColumn("_none", F.col("source").isNull())

    buckets = d.groupBy("_src", "_none", "_bucket").agg(F.sum("size").alias("_in_bucket"))
    along = Window.partitionBy("_src", "_none").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before_bucket", F.coalesce(F.sum("_in_bucket").over(along), F.lit(0)))
    sizes = buckets.groupBy("_src", "_none").agg(F.sum("_in_bucket").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("_none"), F.col("_src")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, share, max_epochs).select(
        F.coalesce(F.col("source"), F.lit("")).alias("_src"), F.col("source").isNull().alias("_none"), "source_size", "target"
    )
    buckets = buckets.join(targets, ["_src", "_none"]).drop("_in_bucket")

    within = Window.partitionBy("_src", "_none", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(buckets, ["_src", "_none", "_bucket"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("_before_bucket") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    gaps = F.split(text, WORD, -1)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_join(F.transform(F.slice(F.arrays_zip(gaps.alias("g"), words.alias("w")), F.lit(1), n.cast("int")), lambda x: F.concat(x["g"], x["w"])), "")


def mixed_documents(docs: DataFrame, **recipe) -> DataFrame:
    """The documents of the mix, with the columns of `docs` (doc_id, text, source, perhaps n_chars).

    A document comes as often as its words are taken in full; the one at the cut comes once more,
    up to its last taken word, with n_chars to match. Documents of which nothing is taken go.
    Where rows share a doc_id, they share what is taken by size.
    """
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))  # so that no column of theirs can clash
    d = whole.select("doc", F.col("doc.doc_id").alias("d"), F.col("doc.source").alias("s"), n_words(F.col("doc.text")).alias("z"))
    taken = mix(d.select(F.col("d").alias("doc_id"), F.col("s").alias("source"), F.col("z").alias("size")), **recipe)
    # Rows alike in all that the mix looks at are told apart by counting them off.
    nth = lambda keys, order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    taken = taken.select(F.col("doc_id").alias("d2"), F.col("source").alias("s2"), F.col("size").alias("z2"), "taken", nth(("doc_id", "source", "size"), F.desc("taken")).alias("m2"))
    d = d.withColumn("m", nth(("d", "s", "z"), F.xxhash64("doc.text")))
    on = F.col("d").eqNullSafe(F.col("d2")) & F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2")) & (F.col("m") == F.col("m2"))
    met = d.join(taken.filter(F.col("taken") > 0), on)
    times = F.floor(F.col("taken") / F.col("z")).cast("int")
    part = F.col("taken") - times * F.col("z")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), times), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = met.select("doc", F.explode(copies).alias("part"))
    cut_text = F.when(F.col("part") > 0, first_words(F.col("doc.text"), F.col("part"))).otherwise(F.col("doc.text"))
    changed = {"text": cut_text, "n_chars": F.when(F.col("part") > 0, F.length(cut_text).cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if c in changed else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mix` over all documents, in words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl
      FROM w WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, round(least(cap, max(lvl) OVER () * weight), 6) AS target FROM v),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', coalesce(CAST(d.doc_id AS VARCHAR), ''), CAST(d.size AS VARCHAR))), d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0::BIGINT ELSE
         (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS taken
FROM p
"""
