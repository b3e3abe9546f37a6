"""Streams and time: events as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.plans.registry import query
from fieldbook.plans.scratch import scratch
from fieldbook.sources.tables import table
from fieldbook.streaming import logs as L


@query("manifest_stream", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def manifest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; the final view of a run that takes all there is."""
    e = table(spark, sf_dir, "events")
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    place = scratch(spark, "stream")
    rows = source.select("user_id", "event_id", "event_type")
    L.manifest_stream(rows, "user_id", "event_id", f"{place}/table", f"{place}/checkpoint").awaitTermination()
    return L.current_view(spark, f"{place}/table", rows.schema, "user_id", "event_id")


@query("idle_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.idle_sessions(table(spark, sf_dir, "events").where("event_type <> 'view'"), "user_id", "ts", "2 hours")


@query("debounce_latest", "SELECT event_id, user_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 3600000000")
def debounce_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.debounce_latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600).select("event_id", "user_id", "event_type")


@query("first_write_per_session", "SELECT CAST(ts AS DATE) AS day, user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def first_write_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type", "event_id")
    return L.first_write_per_session(e, ["day", "user_id", "event_type"], "event_id")
