"""The incremental scan as a stream: new files are scanned as they arrive; `merged` reads what holds after all batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.endpoints import scan
from gleaner.operators.matching import language_of
from gleaner.sources.files import allowed, below, decode


def stream_files(spark: SparkSession, folder: str, max_bytes: int = 10 << 20) -> DataFrame:
    """Files of `folder` as they arrive: path below it, content. Folders that are left out, unknown extensions and large files are passed over, as in `source_files`."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(folder)
    named = stream.filter(F.col("length") <= max_bytes).select(below(F.col("path"), folder).alias("path"), "content")
    return named.filter(allowed(F.col("path")) & language_of(F.col("path")).isNotNull()).select("path", decode(F.col("content")).alias("content"))


def scan_stream(files: DataFrame, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = scan) -> StreamingQuery:
    """Scan each batch of a stream of files and write it below `out`: endpoints, and the paths seen, a folder for each batch, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/endpoints/batch={number}")
        batch.select("path").distinct().write.mode("overwrite").parquet(f"{out}/seen/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, out: str) -> DataFrame:
    """The endpoints (path and others) that hold after all batches of `scan_stream`: a file's are those of the last batch that saw it, none if it has none by now."""
    last = spark.read.parquet(f"{out}/seen").groupBy("path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/endpoints").join(last, ["path", "batch"], "left_semi").drop("batch")


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by window and key of a stream or table of events, with events later than `late` left out of streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
