"""Quarantine: rows, status log, clusters.  State changes are appended, never updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SNIPPET_LIMIT
from .signature import signature_columns


def quarantine(failed: DataFrame) -> DataFrame:
    """Failed rows of ``parse_flat`` -> DLQ rows (status pending)."""
    rows = failed.withColumnRenamed("_payload", "payload")
    rows = signature_columns(rows)
    return rows.selectExpr(
        "event_id", "channel", "source_hint", f"left(text, {SNIPPET_LIMIT}) AS raw_snippet",
        "CASE WHEN coalesce(detail, '') = '' THEN reason ELSE concat(reason, ': ', detail) END AS error",
        "reason", "parser_id", "cluster_id", "cluster_label", "format_guess", "raw_ref", "sha256 AS raw_sha256",
        "CAST(ingest_time AS TIMESTAMP) AS ingest_time", "CAST(ingest_time AS TIMESTAMP) AS ts",
        "'pending' AS status")


def latest(df: DataFrame, keys, order) -> DataFrame:
    """Newest row per key.  An aggregate, so a hot key is reduced before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(packed.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) \
        .select(*df.columns)


def set_status(rows: DataFrame, status: str, at) -> DataFrame:
    """Status-log entries for DLQ rows (append them to the log)."""
    return rows.select("event_id", "cluster_id", F.lit(status).alias("status"), F.lit(at).cast("timestamp").alias("at"))


def current_status(dlq: DataFrame, log: DataFrame) -> DataFrame:
    """DLQ rows with the latest status of the log (pending when it has none)."""
    now = latest(log.select("event_id", F.col("status").alias("_status"), "at"), "event_id", "at")
    joined = dlq.join(now.drop("at"), "event_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).select(*dlq.columns)


def pending(dlq: DataFrame, log: DataFrame) -> DataFrame:
    """Rows neither replayed nor dismissed."""
    done = latest(log.select("event_id", "status", "at"), "event_id", "at").filter(
        F.col("status").isin("replayed", "dismissed"))
    return dlq.filter("status = 'pending'").join(done.select("event_id"), "event_id", "left_anti")


def last_k(df: DataFrame, key, order, k: int, rank: str = "rank") -> DataFrame:
    """Newest k rows per key.

    The rank filter lets Spark cut every map task to k rows per key before the
    shuffle (window group limit), so a hot key never lands whole in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in orders])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def pending_clusters(rows: DataFrame, samples: int = 3) -> DataFrame:
    """One row per (cluster, channel) of pending rows, with the newest snippets."""
    agg = rows.groupBy("cluster_id", "channel").agg(
        F.max("cluster_label").alias("label"), F.max("format_guess").alias("format_guess"),
        F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
        F.array_sort(F.collect_set("parser_id")).alias("parser_ids"))
    newest = last_k(rows, "cluster_id", ["ts", "event_id"], samples).groupBy("cluster_id").agg(
        F.expr("transform(array_sort(collect_list(struct(rank, raw_snippet))), s -> s.raw_snippet)").alias("samples"))
    return agg.join(newest, "cluster_id", "left").orderBy(F.desc("count"), "cluster_id")


def status_counts(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("status").agg(F.count("*").alias("n"))


def recent(dlq: DataFrame, n: int = 50, status: str | None = None) -> DataFrame:
    rows = dlq.filter(F.col("status") == status) if status else dlq
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
