"""Helpers that the pipeline operators share: tables, shared folders, lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.shared import cut, shared_dir

#: White space of every operator contract: space and the code points 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows that a task of a small intermediate table takes.
ROWS_A_TASK = 250_000


def cut_small(df: DataFrame) -> DataFrame:
    """`cut` for tables that are mostly small: read again by a task for each ROWS_A_TASK rows (four at least), so that what is shuffled next is few files."""
    return cut_counted(df)[0]


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`cut_small` and the number of rows, counted while they are written: a job less, as each leaves something in the driver's memory."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return out.coalesce(max(4, -(-n // ROWS_A_TASK))), n


#: So many rows are broadcast at most where a table's size isn't known beforehand.
BROADCAST_ROWS = 500_000
#: A key with over 1/HOT_PARTS of all rows is hot; there are fewer than HOT_PARTS of them.
HOT_PARTS = 2_048
SALTS = 256


def sized(df: DataFrame, small: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """`df` joined with `small`, a checkpointed table: broadcast if it has at most BROADCAST_ROWS rows, else by a shuffle."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def join_hot(df: DataFrame, other: DataFrame, keys: str | list[str], counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The inner join of `df` and `other` (one row for each key), with hot keys salted, so that no task has all rows of one.

    `counts` (keys, n; checkpointed) says how many rows of `df` have a key. Keys of over 1/HOT_PARTS of all rows, fewer than HOT_PARTS
    of them, are marked by a broadcast; their rows of `df` are dealt to SALTS parts by a hash (of the columns `by`), their row of `other` goes to each. Null keys match nothing.
    """
    keys = [keys] if isinstance(keys, str) else keys
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(1, total // HOT_PARTS)
    if most <= limit:
        return df.join(other, keys)
    hot = F.broadcast(counts.filter(F.col("n") > limit).select(*keys, F.lit(True).alias("_hot")))  # fewer than HOT_PARTS rows
    left = df.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*(by or df.columns)), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    right = other.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is; texts that are ASCII alone take the fast way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by its id and text; nulls differ from all values."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    return F.unhex(F.md5(F.concat(part(doc_id), F.lit(":"), part(text)).cast("binary")))


def n_words(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE + "+"))).cast("long")


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
