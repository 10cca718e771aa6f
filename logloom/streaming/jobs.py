"""Structured Streaming: continuous parse, throughput counts, replay dedup (``watch.py``: cluster thresholds)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sinks
from ..operators.archive import write_archive
from ..operators.dlq import quarantine
from ..plans.pipeline import parse_flat, prepare_session, to_events
from ..plans.registry import Registry
from ..sources.ingest import mint_ids
from .watch import changes

Sink = Callable[[DataFrame], None]


def checkpoint_dir(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """Folder below the cluster's shared checkpoint folder; ``fallback`` only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not fallback:
        raise ValueError("spark.checkpoint.dir is not set and no checkpoint folder was given")
    return f"{(shared or fallback).rstrip('/')}/{name}"


def batch_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch={batch_id}"


def table_sinks(events_path: str, dlq_path: str, batch_id: int, archive_path: str | None = None,
                changes_path: str | None = None) -> dict[str, Sink]:
    """Sinks of one micro-batch.  Every batch owns its folder and overwrites it, so a
    batch that is run again after a lost executor or a restart leaves no duplicates.
    Below it, events lie by source and day, as ``read_normalized`` looks for them, and the
    archive by source and hour.  ``changes_path`` feeds the cluster watch."""
    out: dict[str, Sink] = {
        "events": lambda flat: sinks.write_parquet(to_events(flat), batch_path(events_path, batch_id), "overwrite"),
        "dlq": lambda flat: quarantine(flat.filter("reason IS NOT NULL")).write.mode("overwrite").parquet(
            batch_path(dlq_path, batch_id)),
    }
    if archive_path:
        out["archive"] = lambda flat: write_archive(flat, batch_path(archive_path, batch_id), "overwrite")
    if changes_path:
        out["changes"] = lambda flat: changes(quarantine(flat.filter("reason IS NOT NULL")), f"batch {batch_id}").write.mode(
            "overwrite").parquet(batch_path(changes_path, batch_id))
    return out


def parse_stream(raw: DataFrame, registry: Registry, events_path: str, dlq_path: str, checkpoint: str,
                 archive_path: str | None = None, extra: Mapping[str, Sink] | None = None,
                 row_key: str = "file", report: Callable[[int, dict], None] | None = None, changes_path: str | None = None,
                 **trigger) -> StreamingQuery:
    """Raw lines (``raw``, ``channel``, ``ingest_time``) -> event and DLQ tables.

    At-least-once input plus overwritten batch folders gives each line once; equal lines of
    one file, which a batch holds whole, keep ids of their own.  An
    error of a required table fails the batch (it is retried from the
    checkpoint); an ``extra`` sink may fail without stopping the others: ``report``
    gets the batch id and the errors by sink; they are logged in any case.
    """
    prepare_session(raw.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        minted = batch if "event_id" in batch.columns else mint_ids(batch, row_key, number_equal=True)
        flat = parse_flat(minted.withColumn("text", F.expr("make_valid_utf8(CAST(raw AS STRING))")), registry)
        required = table_sinks(events_path, dlq_path, batch_id, archive_path, changes_path)
        failures = sinks.fan_out(flat, {**required, **(extra or {})})
        broken = {k: v for k, v in failures.items() if v and k in required}
        lost = {k: v for k, v in failures.items() if v and k not in required}
        if lost and report:
            report(batch_id, lost)
        if broken:
            raise RuntimeError(f"batch {batch_id}: {broken}")

    return (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def throughput(stream: DataFrame, ts: str = "ts", bucket: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Tumbling counts with a watermark; late lines within it still count."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, bucket)).agg(
        F.count("*").alias("ingested"), F.count_if(F.col("reason").isNull()).alias("parsed"),
        F.count_if(F.col("reason").isNotNull()).alias("dlq")).select(
        F.col("window.start").alias("t"), "ingested", "parsed", "dlq")


def dedup(stream: DataFrame, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Each event id once, for replays that arrive within the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(["event_id"])
