"""Baselines as versions: bucketed tables, and a pointer that only ever moves from one whole version to the next.

A version is written to a folder of its own, bucketed and sorted by path; then a small file that names it is renamed to the version's number
in the folder of commits. A rename to a name that is taken fails, so of two writers one loses and nothing is half there. Readers take
the highest number, or one they ask for. Versions with as many buckets are joined bucket by bucket: neither side is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """The versions below `folder`, which the driver and all executors share. Tables of a version: files (path, md5 and others), endpoints (path and others)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        commits = self._path(f"{self.folder}/commits")
        names = [x.getPath().getName() for x in self._fs.listStatus(commits)] if self._fs.exists(commits) else []
        return sorted(int(n) for n in names if n.isdigit())

    def save(self, files: DataFrame, endpoints: DataFrame, seen: int | None = None) -> int:
        """Write a version and make it the current one; its number. `seen` is the version that the caller started from, the current one by default: if another came since, this one is given up."""
        number = (max(self.versions(), default=0) if seen is None else seen) + 1
        place = f"data-{uuid.uuid4().hex}"
        for name, df in (("files", files), ("endpoints", endpoints)):
            table = f"gleaner_{uuid.uuid4().hex}"
            writer = df.write.format("parquet").bucketBy(self.buckets, "path").sortBy("path").option("path", f"{self.folder}/{place}/{name}")
            writer.saveAsTable(table)
            self.spark.sql(f"DROP TABLE {table}")  # of an outside location: only the name goes
        passing, final = self._path(f"{self.folder}/commits/_{uuid.uuid4().hex}"), self._path(f"{self.folder}/commits/{number:012d}")
        out = self._fs.create(passing)
        out.write(f"{place} {self.buckets}".encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(passing, final):
            self._fs.delete(passing, False)
            raise FileExistsError(f"version {number} was written meanwhile")
        return number

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version, the current one by default; None where there is none."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        commit = self.spark.read.text(f"{self.folder}/commits/{version or known[-1]:012d}").first()[0]
        place, buckets = commit.split(" ")
        location = f"{self.folder}/{place}/{name}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(location).schema)
        table = f"gleaner_{place.replace('-', '_')}_{name}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS LOCATION '{location}'")
        return self.spark.table(table)


    def baseline(self) -> tuple[DataFrame, DataFrame]:
        """The files and endpoints of the current version, as `endpoints.incremental_scan` takes them; empty tables where there is none."""
        files, ends = self.read("files"), self.read("endpoints")
        if files is None:
            files = self.spark.createDataFrame([], "path string, md5 string")
        if ends is None:
            ends = self.spark.createDataFrame([], "path string, line int, method string, route string, auth_status string, risk_level string")
        return files, ends


def changed_between(now: DataFrame, before: DataFrame) -> DataFrame:
    """The rows of `now` (path, md5 and others) that are new or differ from `before`, with `state`: new or changed. Of two versions with as many buckets neither is shuffled."""
    b = before.select(F.col("path").alias("_p"), F.col("md5").alias("_m"))
    met = now.join(b.hint("merge"), F.col("path") == F.col("_p"), "left").filter(~F.col("md5").eqNullSafe(F.col("_m")) | F.col("_p").isNull())
    return met.select(*now.columns, F.when(F.col("_p").isNull(), "new").otherwise("changed").alias("state"))


def gone_between(now: DataFrame, before: DataFrame) -> DataFrame:
    """The paths of `before` that `now` doesn't have."""
    return before.select("path").join(now.select("path").hint("merge"), "path", "left_anti")
