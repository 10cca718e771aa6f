"""The stateful cluster watch: once per new data, closings count, time alone fires, a restart repeats nothing."""

import time

import pytest
from pyspark.sql import functions as F

from logloom.streaming import watch

KEY = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, watch.ROCKS)
    yield spark
    spark.conf.set(KEY, before)


def _rows(spark, cluster, n, ago=0):
    return spark.range(n).select(F.lit(cluster).alias("cluster_id"), F.timestamp_seconds(F.lit(int(time.time()) - ago)).alias("ts"))


def _watch(spark, tmp, got, fired=None, **trigger):
    def on_ready(ready, _):
        got.extend((r["cluster_id"], r["state"], r["pending"]) for r in ready.collect())

    return watch.watch_clusters(spark, f"{tmp}/changes", on_ready, f"{tmp}/cp", fired or watch.ClusterWatch(5, 10, 3600), **trigger)


def _settled(query, rows):
    """Waits until the stream has read ``rows`` rows and finished a batch after that."""
    until, last = time.time() + 60, None
    while time.time() < until:
        progress = query.recentProgress
        if sum(p["numInputRows"] for p in progress) >= rows and progress:
            last = progress[-1]["batchId"] if last is None else last
            if progress[-1]["batchId"] > last:
                return
        time.sleep(0.1)
    raise AssertionError(query.exception() or query.lastProgress)


def test_watch_fires_once_per_new_data(rocks, tmp_path):
    (tmp_path / "changes").mkdir()
    got, read, at = [], 0, 0
    query = _watch(rocks, tmp_path, got, processingTime="0 seconds")

    def add(df):
        nonlocal read, at
        rows = df.collect()  # the clock that decides seconds runs once
        rocks.createDataFrame(rows, watch.CHANGES).coalesce(1).write.parquet(f"{tmp_path}/changes/{at}")
        read, at = read + len(rows), at + 1
        _settled(query, read)
        fired = sorted(got)
        got.clear()
        return fired

    try:
        hot = rocks.createDataFrame(_rows(rocks, "hot", 12).toPandas())
        first = hot.union(_rows(rocks, "old", 6, 7200)).union(_rows(rocks, "few", 4, 7200)).union(_rows(rocks, "young", 9))
        assert add(watch.changes(first, "b0")) == [("hot", "ready", 12), ("old", "ready", 6)]
        # the same batch delivered again counts once
        assert add(watch.changes(hot, "b0").union(watch.changes(_rows(rocks, "young", 1, 5), "b1"))) == [("young", "ready", 10)]
        # all rows replayed: starts afresh, five new ones wait, ten fire
        assert add(watch.changes(hot, "r0", closed=True)) == []
        assert add(watch.changes(_rows(rocks, "hot", 5, 10), "b2")) == []
        query.stop()
        query, read = _watch(rocks, tmp_path, got, processingTime="0 seconds"), 0
        _settled(query, 0)
        assert got == []  # a restart repeats nothing and keeps its counts
        assert add(watch.changes(_rows(rocks, "hot", 5, 11), "b3")) == [("hot", "ready", 10)]
        # new rows on an open proposal refresh at half the threshold; a decision ends what came before it
        assert add(watch.changes(_rows(rocks, "hot", 5, 12), "b4")) == [("hot", "refresh", 15)]
        dismissed = rocks.range(1).select(F.lit("hot").alias("cluster_id"), F.lit("dismissed").alias("status"), F.current_timestamp().alias("updated_at"))
        later = watch.changes(_rows(rocks, "hot", 9, -60), "b5")
        assert add(watch.decisions(dismissed, "d0").union(later.select(*watch.decisions(dismissed, "").columns))) == []
        assert add(watch.changes(_rows(rocks, "hot", 1, -61), "b6")) == [("hot", "ready", 10)]
    finally:
        query.stop()


def test_waiting_cluster_fires_by_time_alone(rocks, tmp_path):
    watch.changes(_rows(rocks, "slow", 6), "b0").write.parquet(f"{tmp_path}/changes/0")
    got = []
    query = _watch(rocks, tmp_path, got, watch.ClusterWatch(5, 10, 4), processingTime="1 second")
    try:
        until = time.time() + 60
        while not got and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert got == [("slow", "ready", 6)]
