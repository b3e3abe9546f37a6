"""The kept state of a stream: bounded folders, restarts between a write and its commit, half-written folders."""

import os
import shutil

from fieldbook.streaming import logs

SCHEMA = "k long, seq long, v string"


def feed(spark, path, n):
    """n files, one a batch, of the keys 0 to 6 and one of their own; file i says i of each."""
    for i in range(n):
        spark.createDataFrame([(k, i, f"{i}") for k in (i % 7, 100 + i)], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/f={i:03d}")


def run(spark, path, table, checkpoint):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    logs.manifest_stream(source, "k", "seq", table, checkpoint).awaitTermination()
    return {r.k: r.v for r in logs.current_view(spark, table, source.schema, "k", "seq").collect()}


def test_folders_stay_few_and_restarts_count_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "MERGE_AFTER", 4)
    path, table, checkpoint = f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/c"
    feed(spark, path, 18)
    got = run(spark, path, table, checkpoint)
    assert set(got) == set(range(7)) | {100 + i for i in range(18)} and all(got[100 + i] == str(i) for i in range(18))
    assert len(os.listdir(table)) <= 2 * 4 + 2
    # a restart after the last folder was written and before the stream noted it
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    assert run(spark, path, table, checkpoint) == got and len(os.listdir(table)) <= 2 * 4 + 2
    # a snapshot and a batch that were not written to their end do not count
    shutil.copytree(f"{table}/batch-{last}", f"{table}/batch-900", ignore=shutil.ignore_patterns("_SUCCESS"))
    shutil.copytree(f"{table}/batch-{last}", f"{table}/snapshot-901", ignore=shutil.ignore_patterns("_SUCCESS"))
    assert run(spark, path, table, checkpoint) == got


def test_a_batch_within_a_snapshot_is_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "MERGE_AFTER", 1)
    path, table, checkpoint = f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/c"
    feed(spark, path, 3)
    got = run(spark, path, table, checkpoint)
    before = sorted(os.listdir(table))
    for name in ("2", ".2.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    assert run(spark, path, table, checkpoint) == got and sorted(os.listdir(table)) == before


def test_an_empty_stream(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert logs.current_view(spark, f"{tmp_path}/none", empty.schema, "k", "seq").collect() == []
