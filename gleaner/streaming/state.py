"""Operators with keyed state on streams: a cache whose entries expire, and the first row of each key in order of arrival.

Both take event time. Keys are dealt to BUCKETS groups by a hash, and the state of a group's keys, kept by Spark's state store (RocksDB, with its changes in the checkpoint
folder), is read and written at once: what a batch costs grows with its rows, not with a call for each key. Timers remove state, and
a query that stops or loses executors goes on from its checkpoint. Rows later than the watermark are left out by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: So many groups of keys have state of their own, a thousand keys in each at four million: a call for a group costs some ten milliseconds, however few its keys are.
BUCKETS = 1 << 12


def with_state_store(spark: SparkSession) -> None:
    """State of these operators needs a store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _micros(at: pd.Series) -> list[int]:
    return at.to_numpy().astype("datetime64[us]").astype("int64").tolist()


def _texts(keys: pd.Series) -> list[str | None]:
    return [k if isinstance(k, str) else None for k in keys.tolist()]


def _grouped(rows: DataFrame, late: str) -> GroupedData:
    """Rows by the bucket of their key, the key as text: a column of numbers with nulls would be one of floats in pandas."""
    return rows.withWatermark("at", late).withColumn("key", F.col("key").cast("string")).withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).groupBy("_bucket")


class TtlCache(StatefulProcessor):
    """The entries of a bucket's keys: `put` rows set them, `get` rows read them while they are at most `ttl` old; a timer removes them when the watermark has passed that."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", StructType([StructField("key", StringType()), StructField("value", StringType()), StructField("at", LongType())]))

    def _read(self) -> dict[str | None, tuple[str | None, int]]:
        return {k: (value, at) for k, value, at in self.entries.get()} if self.entries.exists() else {}

    def _write(self, entries: dict[str | None, tuple[str | None, int]]) -> None:
        if not entries:
            self.entries.clear()
            return
        self.entries.put([(k, value, at) for k, (value, at) in entries.items()])
        self.handle.registerTimer(min(at for _, at in entries.values()) // 1000 + self.ttl // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entries, changed = self._read(), False
        batch = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")  # the rows of one bucket in one batch
        ids, keys, hits, values = [], [], [], []
        for id_, k, at, puts, value in zip(batch["id"].tolist(), _texts(batch["key"]), _micros(batch["at"]), batch["puts"].tolist(), batch["value"].tolist(), strict=True):
            entry = entries.get(k)
            if puts:
                if entry is None or at >= entry[1]:
                    entries[k], changed = (value, at), True
            else:
                hit = entry is not None and entry[1] <= at <= entry[1] + self.ttl
                ids.append(id_)
                keys.append(None if k is None else int(k))
                hits.append(hit)
                values.append(entry[0] if hit else None)
        if changed:
            self._write(entries)
        yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "key": pd.Series(keys, dtype="Int64"), "hit": pd.Series(hits, dtype="bool"), "value": pd.Series(values, dtype="object")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        self._write({k: x for k, x in self._read().items() if x[1] + self.ttl >= now})
        return iter(())

    def close(self) -> None:
        pass


def cache_stream(rows: DataFrame, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(id, key, hit, value) for each lookup of a stream `rows` (id bigint, key bigint, at timestamp, puts boolean, value string): whether the key's last entry before it, in order of `at` and id within a batch, is at most `ttl_seconds` old.

    Rows with `puts` set the key's entry, an older one never replaces a newer one. Null keys are a key. State of an entry goes when the watermark has passed its time.
    """
    with_state_store(rows.sparkSession)
    return _grouped(rows, late).transformWithStateInPandas(statefulProcessor=TtlCache(ttl_seconds), outputStructType="id bigint, key bigint, hit boolean, value string", outputMode="Append", timeMode="EventTime")


class FirstSeen(StatefulProcessor):
    """The first rows of a bucket's keys: later batches' rows, and all but the least by `at` and id of a key in its own batch, are left out, until a timer forgets the key."""

    def __init__(self, remember_seconds: int):
        self.remember = remember_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", StructType([StructField("key", StringType()), StructField("until", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = {k for k, _ in self.seen.get()} if self.seen.exists() else set()
        first: dict[str | None, tuple[int, int]] = {}
        for part in rows:
            for k, at, id_ in zip(_texts(part["key"]), _micros(part["at"]), part["id"].tolist(), strict=True):
                if k not in seen and (k not in first or (at, id_) < first[k]):
                    first[k] = (at, id_)
        if first:
            new = [(k, at // 1000 + self.remember) for k, (at, _) in first.items()]
            self.seen.appendList(new)
            self.handle.registerTimer(min(until for _, until in new))
            yield pd.DataFrame({"key": pd.Series(list(first), dtype="object"), "id": [int(x[1]) for x in first.values()], "at": pd.to_datetime([x[0] for x in first.values()], unit="us")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        left = [(k, until) for k, until in self.seen.get() if until > due and until >= now] if self.seen.exists() else []
        if left:
            self.seen.put(left)
            self.handle.registerTimer(min(until for _, until in left))
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, remember_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, id, at): the first row of each key of a stream `rows` (key string, id bigint, at timestamp) in order of arrival, batch by batch and within a batch by `at` and id; a key is forgotten `remember_seconds` after its first row."""
    with_state_store(rows.sparkSession)
    return _grouped(rows, late).transformWithStateInPandas(statefulProcessor=FirstSeen(remember_seconds), outputStructType="key string, id bigint, at timestamp", outputMode="Append", timeMode="EventTime")
