"""Structured Streaming forms of change detection, rate limits and request counts.

Each query drains what is there (available-now trigger), so it can be compared
with its batch form; the same transformations run continuously on a live source.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from permrisk.sources.scratch import fresh

FILES_A_TRIGGER = 4
CAPACITY, REFILL_A_HOUR = 5.0, 1.0
#: a bucket is full again by then, so nothing is lost with its state
IDLE_MS = 6 * 3_600_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_A_TRIGGER).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _span(spark: SparkSession, sf_dir: str, least: int) -> str:
    """A watermark's delay in seconds: the time the table covers, so that files in any order are never late, and ``least`` at least."""
    a, b = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").cast("double").alias("t")).agg(F.min("t"), F.max("t")).first()
    return f"{least if a is None else max(least, math.ceil(b - a) + 1)} seconds"


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream to its present end into a table of the shared folder. A batch that is tried again overwrites itself."""
    spark = stream.sparkSession
    path = fresh(spark, label)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", fresh(spark, f"{label}-state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by hour and type; an hour is closed ten minutes late, or by the table's span if its files overlap in time."""
    stream = _events(spark, sf_dir).withWatermark("ts", _span(spark, sf_dir, 600)).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = drained(stream.select(F.col("w.start").alias("hour"), "event_type", "n", "total"), "window", "update")
    # in update mode an hour is written each time it changes: the last count is the largest, and its total the last one
    return out.groupBy(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


WINDOW_SQL = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of watched counties, each event once, joined with the static list of watches."""
    watched = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 10 = 0").select((F.col("user_id") % 25).alias("county_id")).distinct()
    stream = _events(spark, sf_dir).withWatermark("ts", _span(spark, sf_dir, 3 * 86400)).dropDuplicatesWithinWatermark(["event_id"]).where("event_type <> 'view'").withColumn("county_id", F.col("user_id") % 25)
    return drained(stream.join(watched, "county_id", "left_semi").select("event_id", "county_id", "event_type"), "changes")


CHANGE_SQL = "SELECT event_id, user_id % 25 AS county_id, event_type FROM events WHERE event_type <> 'view' AND user_id % 25 IN (SELECT user_id % 25 FROM events WHERE user_id % 10 = 0)"


def _take(key, batches, state: GroupState):
    """Requests of one key in order of time against a bucket that refills; a key that is idle for ``IDLE_MS`` is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    tokens, last = state.get if state.exists else (CAPACITY, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    allowed = denied = 0
    for ts in rows["ts"]:
        now = ts.timestamp()
        tokens = min(CAPACITY, tokens + (0 if last is None else max(0.0, now - last) / 3600 * REFILL_A_HOUR))
        last = now
        if tokens >= 1:
            tokens, allowed = tokens - 1, allowed + 1
        else:
            denied += 1
    state.update((tokens, last))
    state.setTimeoutTimestamp(int(last * 1000) + IDLE_MS)
    yield pd.DataFrame({"user_id": [key[0]], "allowed": [allowed], "denied": [denied]})


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests let through and turned away for each user, with the bucket kept as keyed state."""
    stream = _events(spark, sf_dir).withWatermark("ts", _span(spark, sf_dir, 600)).select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(_take, "user_id bigint, allowed bigint, denied bigint", "tokens double, last double", "update", GroupStateTimeout.EventTimeTimeout)
    return drained(stream, "bucket", "update").groupBy("user_id").agg(F.sum("allowed").alias("allowed"), F.sum("denied").alias("denied"))


BUCKET_SQL = """
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    walk AS (SELECT user_id, i, t, CAST(4.0 AS DOUBLE) AS tokens, true AS ok FROM e WHERE i = 1
             UNION ALL SELECT e.user_id, e.i, e.t, least(5.0, w.tokens + (e.t - w.t) / 3600000000.0) - CASE WHEN least(5.0, w.tokens + (e.t - w.t) / 3600000000.0) >= 1 THEN 1 ELSE 0 END, least(5.0, w.tokens + (e.t - w.t) / 3600000000.0) >= 1
             FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
    SELECT user_id, count(*) FILTER (WHERE ok) AS allowed, count(*) FILTER (WHERE NOT ok) AS denied FROM walk GROUP BY user_id"""

QUERIES = {"stream_window_counts": (window_counts, WINDOW_SQL), "stream_changes": (change_stream, CHANGE_SQL), "stream_token_bucket": (token_bucket, BUCKET_SQL)}
