"""Pipeline metrics as aggregations over outcomes; nothing is kept in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def totals(outcomes: DataFrame) -> DataFrame:
    """One row of counters from outcomes (reason; and ``total_replayed`` where they tell, in a boolean ``replayed``,
    which lines came back from quarantine)."""
    ok = F.col("reason").isNull()
    replayed = [F.count_if("replayed").alias("total_replayed")] if "replayed" in outcomes.columns else []
    counted = outcomes.agg(
        F.count("*").alias("total_ingested"), F.count_if(ok).alias("total_parsed"),
        F.count_if(~ok).alias("total_dlq"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in
          ("no_parser_match", "tokenize_failed", "normalize_error", "schema_violation")], *replayed)
    return counted.withColumn("parse_success_rate_pct", F.expr(
        "CASE WHEN total_ingested > 0 THEN round(total_parsed / total_ingested * 100, 2) END"))


def by_source(outcomes: DataFrame) -> DataFrame:
    """Parsed and quarantined counts per source; unknown lines count under their channel."""
    name = F.expr("coalesce(source_id, parser_id, concat('unknown@', channel))")
    return outcomes.groupBy(name.alias("source")).agg(
        F.count_if(F.col("reason").isNull()).alias("parsed"), F.count_if(F.col("reason").isNotNull()).alias("dlq"),
        F.max("ts").alias("last_seen"))


def _micros(bucket: str) -> str:
    return f"unix_micros(timestamp_micros(0) + INTERVAL {bucket})"


def history(outcomes: DataFrame, bucket: str = "1 second", last: int | None = 120) -> DataFrame:
    """Counts per time bucket without gaps, of the ``last`` buckets or of all.

    Buckets are aggregated first and written out; the first and last of them bound a range that Spark deals over
    tasks, so that years of seconds are no single task's work.
    """
    counts = cut(outcomes.filter("ts IS NOT NULL").groupBy(F.window("ts", bucket).start.alias("t")).agg(
        F.count("*").alias("ingested"), F.count_if(F.col("reason").isNull()).alias("parsed"),
        F.count_if(F.col("reason").isNotNull()).alias("dlq")))
    span = counts.agg(F.expr("min(unix_micros(CAST(t AS TIMESTAMP)))").alias("a"), F.expr("max(unix_micros(CAST(t AS TIMESTAMP)))").alias("b"),
                      F.max(F.expr(_micros(bucket))).alias("step")).first()
    if span["a"] is None:
        return counts
    n = (span["b"] - span["a"]) // span["step"] + 1
    skipped = max(0, n - last) if last else 0
    spine = outcomes.sparkSession.range(skipped, n).select(F.expr(f"timestamp_micros({span['a']}L + id * {span['step']}L)").alias("t"))
    filled = spine.join(counts, "t", "left")
    return filled.select("t", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ingested", "parsed", "dlq")])


def events_per_bucket(hist: DataFrame, n: int = 10, bucket: str = "1 second") -> DataFrame:
    """Sum and mean of the last n completed buckets at every bucket of ``hist``.

    Every bucket is handed to the n that follow it, a sum by bucket: no task sees more than its share of the time.
    """
    given = hist.selectExpr(f"explode(transform(sequence(1, {n}), i -> timestamp_micros(unix_micros(CAST(t AS TIMESTAMP)) + i * {_micros(bucket)}))) AS t",
                            "ingested AS before").groupBy("t").agg(F.sum("before").alias("last_sum"), F.count("before").alias("last_n"))
    return hist.select("t", "ingested").join(given, "t", "left").selectExpr(
        "t", "ingested", "coalesce(last_sum, 0) AS last_sum", "coalesce(last_n, 0) AS last_n").withColumn(
        "per_bucket", F.expr("round(last_sum / greatest(last_n, 1), 2)"))


def recent_events(flat: DataFrame, n: int = 50, source: str | None = None, class_uid: int | None = None) -> DataFrame:
    """Newest n normalized events (a bounded top-n, no global sort)."""
    if source:
        flat = flat.filter(F.col("source_id") == source)
    if class_uid:
        flat = flat.filter(F.col("class_uid") == class_uid)
    return flat.orderBy(F.desc("time"), F.desc("event_id")).limit(n)


def mode(df: DataFrame, keys, value: str, position: str) -> DataFrame:
    """Most frequent value per key; the value seen first wins a tie."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_n"), F.min(position).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value),
                                     F.max("_n").alias("votes"))
