"""Streams of events, replayed in three batches: the cache with state and the first row of each key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.query import query, table
from gleaner.sources.shared import shared_dir
from gleaner.streaming.state import cache_stream, first_seen

#: When the second and the third batch begin; a row in this many comes with the last batch, however old it is.
SECOND, THIRD, HELD = "2024-01-11 00:00:00", "2024-01-21 00:00:00", 97
_TTL, _LATE = 6 * 3600, 86_400


def replayed(spark: SparkSession, sf_dir: str, columns: str) -> tuple[str, str]:
    """A folder with three files of events, a batch each, and one for what comes of them. Times are written as instants of UTC."""
    folder = f"{shared_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    part = F.when((F.col("event_id") % HELD == 0) | (F.col("ts") >= F.lit(THIRD).cast("timestamp_ntz")), 3).when(F.col("ts") >= F.lit(SECOND).cast("timestamp_ntz"), 2).otherwise(1)
    e = e.withColumn("_part", part)
    for k in (1, 2, 3):  # a file each, so that a batch is a slice of the table
        e.filter(F.col("_part") == k).selectExpr(*columns.split(";")).coalesce(1).write.parquet(f"{folder}/in/batch={k}")
    return f"{folder}/in", folder


def ran(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """What a stream writes until all files are read, one file a batch."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def source(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


# A row is late if it is older than the watermark of the batch before its own: the latest time of the batches before that one, less the time allowed.
_BATCHES = f"""b AS (SELECT *, CASE WHEN event_id % {HELD} = 0 OR ts >= TIMESTAMP '{THIRD}' THEN 3 WHEN ts >= TIMESTAMP '{SECOND}' THEN 2 ELSE 1 END AS part FROM events),
w AS (SELECT 1 AS part, TIMESTAMP '1970-01-01' AS mark UNION ALL SELECT p, coalesce((SELECT max(ts) - INTERVAL {_LATE} SECOND FROM b WHERE part < p - 1), TIMESTAMP '1970-01-01') FROM (VALUES (2), (3)) AS t(p)),
e AS (SELECT b.* FROM b JOIN w USING (part) WHERE epoch_ms(ts) > epoch_ms(mark))"""


@query(f"""WITH {_BATCHES}, g AS (SELECT event_id, user_id, part, ts, event_type IN ('purchase', 'signup') AS puts, CAST(value AS VARCHAR) AS value FROM e),
p AS (SELECT g.event_id AS id, g.user_id AS key, g.ts, x.ts AS put_at, x.value FROM g LEFT JOIN g x ON x.puts AND x.user_id = g.user_id AND (x.part < g.part OR (x.part = g.part AND (x.ts, x.event_id) < (g.ts, g.event_id)))
 WHERE NOT g.puts QUALIFY row_number() OVER (PARTITION BY g.event_id ORDER BY x.ts DESC NULLS LAST, x.event_id DESC) = 1)
SELECT id, key, coalesce(put_at <= ts AND put_at + INTERVAL {_TTL} SECOND >= ts, false) AS hit, CASE WHEN put_at <= ts AND put_at + INTERVAL {_TTL} SECOND >= ts THEN value END AS value FROM p""")
def cache_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and signups are entries of their user, other events look them up within six hours; some events come late, some so late that they don't count."""
    rows, folder = replayed(spark, sf_dir, "event_id AS id;user_id AS key;at;event_type IN ('purchase', 'signup') AS puts;CAST(value AS STRING) AS value")
    return ran(spark, cache_stream(source(spark, rows, "id bigint, key bigint, at timestamp, puts boolean, value string"), _TTL, f"{_LATE} seconds"), folder)


@query(f"""WITH {_BATCHES} SELECT key, id FROM (SELECT user_id || ':' || event_type AS key, event_id AS id, part, ts FROM e)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY part, ts, id) = 1""")
def first_in_arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, as they arrive."""
    rows, folder = replayed(spark, sf_dir, "concat(user_id, ':', event_type) AS key;event_id AS id;at")
    return ran(spark, first_seen(source(spark, rows, "key string, id bigint, at timestamp"), 90 * 86_400, f"{_LATE} seconds"), folder).select("key", "id")
