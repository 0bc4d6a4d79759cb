"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import SPACE_CHARS, UPPER, ascii_lower, cut, join_hot, strip, table


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop the lines whose key is found in `min_docs` or more documents, but for the largest doc_id that holds it.

    Returns a row for each row of `docs` (doc_id, text): doc_id, n_lines, n_dropped, kept_text.
    A key is the line without white space at its ends and with A-Z in lower case; shorter keys than
    `min_chars` code points never count. Null and empty texts are one empty line. Rows with the same
    doc_id count as one document; all null ids are one document that ranks below every other.
    Repeated rows each come back. Other columns of `docs` are ignored.

    Only hashes of lines (two of 64 bits) and line positions are shuffled for counting; texts move
    once, to meet the positions of their dropped lines. The hashes of shared lines are written to the checkpoint folder; those of very common
    lines are salted.
    """
    d = docs.select(
        F.col("doc_id"),
        F.xxhash64("text").alias("_row"),
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1).alias("_lines"),
    )
    key = ascii_lower(strip(F.col("_line")))
    lines = (
        d.select("doc_id", "_row", F.posexplode("_lines").alias("_pos", "_line"))
        .filter(F.octet_length("_line") >= min_chars)
        .withColumn("_key", key)
        .filter(F.length("_key") >= min_chars)
        .select("doc_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2"))
    )
    shared = cut(
        lines.groupBy("_h1", "_h2")
        .agg(
            (F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))).alias("_n"),
            F.max("doc_id").alias("_keeper"),
            F.count("*").alias("n"),
        )
        .filter(F.col("_n") >= min_docs)
        .drop("_n")
    )
    dropped = (
        join_hot(lines, shared.drop("n"), ["_h1", "_h2"], shared)
        .filter(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_row2"))
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    met = d.join(dropped, d["doc_id"].eqNullSafe(dropped["_doc"]) & (d["_row"] == dropped["_row2"]), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    return met.select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n"))
        .otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
        .alias("kept_text"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of `line_dedup` over all documents."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_SPACES = " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS)
OP1_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.keeper AS dropped FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""
