"""Raw archive: lossless originals with their hash, and the checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SNIPPET_LIMIT


def archive_rows(df: DataFrame) -> DataFrame:
    """Raw events -> archive rows (partition columns ``source`` and ``ingest_hour``)."""
    return df.selectExpr(
        "event_id", "raw", "sha256", "size_bytes", "raw_ref", "channel", "source_hint", "ingest_time",
        "split(substring_index(raw_ref, '://', -1), '/')[0] AS source",
        "date_format(ingest_time, 'yyyyMMddHH') AS ingest_hour")


def write_archive(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append-only Parquet, by source and hour.

    No shuffle: every task writes what it read, so a hot source is spread over as
    many tasks as its input was.  Compact small files separately.
    """
    rows = archive_rows(df)
    rows.write.mode(mode).partitionBy("source", "ingest_hour").option("compression", "zstd").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_ref(ref: str = "raw_ref") -> tuple:
    """Columns (source, event id) of a raw reference."""
    path = F.substring_index(F.col(ref), "://", -1)
    return F.split(path, "/")[0], F.regexp_extract(path, "^[^/]*/(?:.*#)?([^#]*)$", 1)


def verify(archive: DataFrame) -> DataFrame:
    """Re-hash every archived original."""
    return archive.withColumn("computed_sha256", F.expr("sha2(raw, 256)")).withColumn(
        "verified", F.expr("computed_sha256 <=> sha256"))


def audit(archive: DataFrame, normalized: DataFrame) -> DataFrame:
    """Archive against events: hash re-check and link check, one row per archived original.

    ``normalized`` needs ``event_id`` and ``raw_sha256`` only, so the join moves
    hashes, not events; the originals are hashed before the shuffle and left out.
    """
    left = verify(archive).select("event_id", "raw_ref", F.col("sha256").alias("stored_sha256"),
                                  "computed_sha256", "verified")
    right = normalized.select("event_id", F.col("raw_sha256").alias("normalized_sha256"))
    return left.join(right, "event_id", "left").withColumn(
        "link_ok", F.expr("normalized_sha256 IS NULL OR normalized_sha256 = computed_sha256"))


def trace(normalized: DataFrame, archive: DataFrame) -> DataFrame:
    """Events with their archived original."""
    return normalized.join(archive.select("event_id", "raw", F.col("sha256").alias("stored_sha256")), "event_id")


def find_event(ids: DataFrame, normalized: DataFrame, dlq: DataFrame) -> DataFrame:
    """Where each id ended: ``normalized`` first, else ``dlq``, else NULL."""
    n = normalized.select("event_id", F.lit("normalized").alias("_n"), F.col("source_id").alias("_sid"))
    d = dlq.select("event_id", F.lit("dlq").alias("_d"), F.col("reason").alias("_reason"))
    out = ids.join(n, "event_id", "left").join(d, "event_id", "left")
    return out.select(*ids.columns, F.coalesce("_n", "_d").alias("status"), F.col("_sid").alias("source_id"),
                      F.when(F.col("_n").isNull(), F.col("_reason")).alias("reason"))


def replay_source(dlq: DataFrame, archive: DataFrame) -> DataFrame:
    """Quarantined rows with their original bytes. Where the archive has none, the snippet serves if it is the whole
    line; of a longer line only a part is left, and ``raw`` is NULL."""
    originals = archive.select("event_id", F.col("raw").alias("_raw"))
    out = dlq.join(originals, "event_id", "left")
    whole = F.when(F.char_length("raw_snippet") < SNIPPET_LIMIT, F.col("raw_snippet").cast("binary"))
    return out.select(*dlq.columns, F.coalesce("_raw", whole).alias("raw"), F.col("_raw").isNotNull().alias("from_archive"))
