"""The cluster watch as a stateful stream: which quarantine clusters need a proposal, and when.

The stream carries changes, not rows: per cluster and second, how many quarantine rows came (positive) or were
replayed or dismissed (negative), summed before they are written, so that a hot cluster is a handful of rows of
each batch.  State is kept per cluster: the pending count of every second that still has any, what was fired,
and the last decision.  A timer wakes a cluster whose oldest row has waited long enough, with no new input.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.heal import COUNT_THRESHOLD, MAX_WAIT_SECONDS, MIN_SAMPLES

#: change is NULL for a decision (promotion or dismissal) of the cluster's proposal.
CHANGES = "origin STRING, cluster_id STRING, second BIGINT, change BIGINT"
READY = "cluster_id STRING, state STRING, pending BIGINT, oldest TIMESTAMP"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changes(rows: DataFrame, origin: str, closed: bool = False) -> DataFrame:
    """Changes of quarantine rows (``cluster_id``, ``ts``) that came, or with ``closed`` left.  ``origin`` names the
    batch or replay: a second delivery of the same origin counts once."""
    return rows.groupBy("cluster_id", F.unix_seconds("ts").alias("second")).agg(
        F.count("*").alias("n")).selectExpr(f"'{origin}' AS origin", "cluster_id", "second", f"{'-' if closed else ''}n AS change")


def decisions(proposals: DataFrame, origin: str) -> DataFrame:
    """Promoted and dismissed proposals (``cluster_id``, ``updated_at``): rows up to then count no more."""
    return proposals.filter("status IN ('promoted', 'dismissed')").selectExpr(
        f"'{origin}' AS origin", "cluster_id", "unix_seconds(updated_at) AS second", "CAST(NULL AS BIGINT) AS change")


class ClusterWatch(StatefulProcessor):
    """Fires 'ready' at ``count_threshold`` pending rows, or at ``min_samples`` once the oldest waited ``max_wait``
    seconds; then 'refresh' at half the threshold of new rows, or any new row after ``max_wait``.  Without new rows
    it stays silent; when nothing is pending it starts afresh."""

    def __init__(self, min_samples: int = MIN_SAMPLES, count_threshold: int = COUNT_THRESHOLD,
                 max_wait: int = MAX_WAIT_SECONDS, remember: str = "7 days"):
        self.min_samples, self.threshold, self.max_wait = min_samples, count_threshold, max_wait
        self.remember_ms = int(pd.Timedelta(remember).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seconds = handle.getMapState("seconds", "second BIGINT", "n BIGINT")
        # origins are remembered for a while: a retry of a writer comes soon or not at all
        self.origins = handle.getMapState("origins", "origin STRING, second BIGINT, kind INT", "seen BOOLEAN", self.remember_ms)
        self.facts = handle.getValueState("facts", "fired_at BIGINT, fresh BIGINT, decided BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fired_at, fresh, decided = self.facts.get() or (None, 0, None)
        for pdf in rows:
            for origin, second, change in zip(pdf["origin"], pdf["second"], pdf["change"], strict=True):
                kind = 0 if pd.isna(change) else 1 if change > 0 else -1
                mark = (origin, int(second), kind)
                if self.origins.containsKey(mark):
                    continue
                self.origins.updateValue(mark, (True,))
                if kind == 0:
                    decided = max(decided or 0, int(second))
                    fired_at, fresh = None, 0
                    continue
                held = self.seconds.getValue((int(second),))
                self.seconds.updateValue((int(second),), ((held[0] if held else 0) + int(change),))
                fresh += max(int(change), 0)
        yield from self._judged(key, fired_at, fresh, decided, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired_at, fresh, decided = self.facts.get() or (None, 0, None)
        yield from self._judged(key, fired_at, fresh, decided, timerValues)

    def _judged(self, key, fired_at, fresh, decided, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentProcessingTimeInMs() // 1000
        pending, oldest = 0, None
        gone = []
        for (second,), (n,) in self.seconds.iterator():
            if n == 0 or decided is not None and second <= decided:
                gone.append(second)  # a closing that came first is negative and stays until its rows come
            elif n > 0:
                pending += n
                oldest = second if oldest is None else min(oldest, second)
        for second in gone:
            self.seconds.removeKey((second,))
        if not pending:
            fired_at, fresh = None, 0
        due, state = None, None
        if fired_at is None:
            if pending >= self.min_samples:
                due = oldest + self.max_wait
                state = "ready" if pending >= self.threshold or now >= due else None
        elif fresh:
            due = fired_at + self.max_wait
            state = "refresh" if fresh >= max(1, self.threshold // 2) or now >= due else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state:
            fired_at, fresh = now, 0
        elif due is not None:
            self.handle.registerTimer(max(due * 1000, timers.getCurrentProcessingTimeInMs() + 1))
        self.facts.update((fired_at, fresh, decided))
        if state:
            yield pd.DataFrame({"cluster_id": [key[0]], "state": [state], "pending": [pending],
                                "oldest": [dt.datetime.fromtimestamp(oldest, dt.timezone.utc)]})


def watch_clusters(spark: SparkSession, changes_path: str, on_ready: Callable[[DataFrame, int], None], checkpoint: str,
                   watch: ClusterWatch | None = None, max_files: int | None = None, **trigger) -> StreamingQuery:
    """Reads change tables as they land and hands ``on_ready`` the clusters that need a proposal, once per new data.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``) in the session.  ``on_ready`` is
    called with the batch id and may see a batch again after a failure.
    """
    reader = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ready = reader.parquet(changes_path).filter("cluster_id IS NOT NULL AND second IS NOT NULL").groupBy("cluster_id").transformWithStateInPandas(
        watch or ClusterWatch(), READY, "Update", "ProcessingTime")
    return (ready.writeStream.outputMode("update").foreachBatch(on_ready).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())
