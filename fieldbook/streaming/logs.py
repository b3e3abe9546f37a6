"""Logs as streams: latest-wins views, idle sessions, bursts, first writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldbook.sources.shared import committed_folders, remove_folder


#: Batches that are kept as folders of their own before they are merged.
MERGE_AFTER = 8


def _versions(spark: SparkSession, table: str, kind: str) -> list[int]:
    return sorted(int(n.split("-")[1]) for n in committed_folders(spark, table) if n.startswith(f"{kind}-"))


def stored_rows(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """All rows of the current state of a table that manifest_stream keeps: the last snapshot and the batches after it."""
    snapshots = _versions(spark, table, "snapshot")
    last = snapshots[-1] if snapshots else -1
    paths = [f"{table}/snapshot-{last}"] * bool(snapshots) + [f"{table}/batch-{n}" for n in _versions(spark, table, "batch") if n > last]
    return spark.read.schema(schema).parquet(*paths).select(*schema.names) if paths else spark.createDataFrame([], schema)


def manifest_stream(source: DataFrame, key: str, order: str, table: str, checkpoint: str):
    """Keep the last row of each key of a stream as Parquet under table; returns the query.

    A batch is reduced to a row a key and written as a folder of its number.  After MERGE_AFTER batches they
    are merged with the last snapshot into a new one, which holds all batches up to its number.  A folder counts once
    Spark has put its mark of success there, which is one step, so readers see the old state or the new.  A batch
    that is run again after a restart replaces its own folder, or is left out where a snapshot
    holds it already.  What lies before the snapshot before the last is removed; so a reader may use a
    state for as long as it takes to write two more, and the folders are 2 * MERGE_AFTER + 2 at most.
    A table belongs to one checkpoint.  Read with current_view.
    """
    schema = source.schema

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        snapshots = _versions(spark, table, "snapshot")
        if snapshots and number <= snapshots[-1]:
            return
        latest_view(batch, key, order).select(*schema.names).write.mode("overwrite").parquet(f"{table}/batch-{number}")
        last = snapshots[-1] if snapshots else -1
        if number - last >= MERGE_AFTER:
            latest_view(stored_rows(spark, table, schema), key, order).select(*schema.names).write.mode("overwrite").parquet(f"{table}/snapshot-{number}")
            for kind in ("snapshot", "batch"):
                for n in _versions(spark, table, kind):
                    if n < last or (kind == "batch" and n == last):
                        remove_folder(spark, f"{table}/{kind}-{n}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_view(stored: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; the order's ties are broken by the other columns, so that a second look gives the same."""
    rest = [c for c in stored.columns if c != key]
    return stored.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")


def current_view(spark: SparkSession, table: str, schema: StructType, key: str, order: str) -> DataFrame:
    """The last row of each key of a table that manifest_stream keeps."""
    return latest_view(stored_rows(spark, table, schema), key, order)


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, end, n): sessions that end after a gap without activity; works on streams with a watermark.

    A window takes in what comes at its very end, so it is a microsecond short of the gap.
    """
    s = events.groupBy(key, F.session_window(ts, f"{gap} -1 microseconds").alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("end"), F.min(ts).alias("start"))
    return s.select(key, "start", "end", "n")


def debounce_latest(events: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """The last event of each burst: those that the next of their key follows no sooner than so many seconds.

    A burst is a session of that gap (a window takes in what comes at its very end); works on streams with a watermark, which give a burst once it is over.
    """
    rest = [c for c in events.columns if c != key]
    s = events.groupBy(key, F.session_window(ts, f"{round(seconds * 1e6) - 1} microseconds").alias("w")).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("r"))
    return s.select(key, "r.*").select(*events.columns)


def first_write_per_session(events: DataFrame, session: list[str], order: str) -> DataFrame:
    rest = [c for c in events.columns if c not in session]
    return events.groupBy(*session).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*session, "r.*")


def first_arrival_per_session(stream: DataFrame, session: list[str]) -> DataFrame:
    """The first row of each session as a stream brings it, at once; a stream with a watermark forgets sessions it has passed."""
    return stream.dropDuplicatesWithinWatermark(session)
