"""Sinks: JSON lake, flat Parquet, feature table, CEF, bulk NDJSON, Kafka frame."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqltext import lookup, q
from ..schema import CEF_SEVERITY, SCHEMA_VERSION

log = logging.getLogger(__name__)

# The feature table, column -> (event path, type).
FEATURES = {
    "time_ms": ("time", "bigint"), "source_id": ("metadata.source_id", "string"),
    "vendor": ("metadata.product.vendor_name", "string"), "class_uid": ("class_uid", "bigint"),
    "activity_id": ("activity_id", "bigint"), "severity_id": ("severity_id", "bigint"),
    "action_id": ("action_id", "bigint"), "disposition_id": ("disposition_id", "bigint"),
    "src_ip": ("src_endpoint.ip", "string"), "dst_ip": ("dst_endpoint.ip", "string"),
    "src_port": ("src_endpoint.port", "bigint"), "dst_port": ("dst_endpoint.port", "bigint"),
    "protocol_num": ("connection_info.protocol_num", "bigint"),
    "direction_id": ("connection_info.direction_id", "bigint"),
    "bytes_in": ("traffic.bytes_in", "bigint"), "bytes_out": ("traffic.bytes_out", "bigint"),
    "src_is_internal": ("enrichments.src_is_internal", "boolean"),
    "dst_is_internal": ("enrichments.dst_is_internal", "boolean"),
    "dst_port_risky": ("enrichments.dst_port_risky", "boolean"),
    "is_blocked": ("enrichments.is_blocked", "boolean"), "is_finding": ("enrichments.is_finding", "boolean"),
    "uid": ("metadata.uid", "string"), "raw_sha256": ("metadata.raw_sha256", "string"),
}


def with_partitions(events: DataFrame) -> DataFrame:
    """Adds the lake's partition columns."""
    return events.withColumn("source_id", F.col("metadata.source_id")).withColumn("day", F.substring("time_dt", 1, 10))


def write_jsonl(events: DataFrame, path: str, mode: str = "append") -> None:
    with_partitions(events).write.mode(mode).partitionBy("source_id", "day").json(path)


def write_parquet(events: DataFrame, path: str, mode: str = "append") -> None:
    with_partitions(events).write.mode(mode).partitionBy("source_id", "day").parquet(path)


def flatten_columns(df: DataFrame) -> DataFrame:
    """Nested record -> dotted flat columns; maps and arrays become JSON text."""
    out = []

    def walk(dtype: T.DataType, path: list[str]) -> None:
        ref = ".".join(f"`{p}`" for p in path)
        name = ".".join(path)
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, [*path, f.name])
        elif isinstance(dtype, (T.MapType, T.ArrayType)):
            out.append(F.to_json(F.col(ref)).alias(name))
        else:
            out.append(F.col(ref).alias(name))

    for f in df.schema.fields:
        walk(f.dataType, [f.name])
    return df.select(*out)


def write_flat(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat = flatten_columns(events).withColumn("source_id", F.col("`metadata.source_id`"))
    flat.write.mode(mode).partitionBy("source_id").parquet(path)


def feature_table(events: DataFrame, ordered: bool = True) -> DataFrame:
    """The ML table; integers that do not parse become NULL.

    A range sort reads its input twice, once for the sample of its borders. The shuffle by ``uid`` before it keeps the
    finished rows, so that the events are parsed once.
    """
    cols = [F.expr(f"try_cast({path} AS {typ})").alias(name) for name, (path, typ) in FEATURES.items()]
    out = events.select(*cols)
    return out.repartition("uid").orderBy("time_ms", "uid") if ordered else out


def cef_escape_header(s: str) -> str:
    return f"replace(replace({s}, {q(chr(92))}, {q(chr(92) * 2)}), '|', {q(chr(92) + '|')})"


def cef_escape_ext(s: str) -> str:
    return (f"replace(replace(replace({s}, {q(chr(92))}, {q(chr(92) * 2)}), '=', {q(chr(92) + '=')}),"
            f" {q(chr(10))}, {q(chr(92) + 'n')})")


def to_cef(events: DataFrame, out: str = "cef", vendor: str = "Logloom", product: str = "Log normalizer",
           version: str = SCHEMA_VERSION) -> DataFrame:
    """Adds one CEF line per event, with the labels that lead back to the original."""
    sev = f"coalesce({lookup(CEF_SEVERITY, 'CAST(severity_id AS STRING)')}, '0')"
    ext = {
        "rt": "CAST(time AS STRING)", "src": "src_endpoint.ip", "spt": "CAST(src_endpoint.port AS STRING)",
        "dst": "dst_endpoint.ip", "dpt": "CAST(dst_endpoint.port AS STRING)", "proto": "connection_info.protocol_name",
        "act": "disposition", "suser": "actor.user.name",
        "msg": "coalesce(nullif(finding_info.title, ''), message)",
        "cs1Label": "'event_uid'", "cs1": "metadata.uid", "cs2Label": "'raw_sha256'", "cs2": "metadata.raw_sha256",
        "cs3Label": "'raw_ref'", "cs3": "metadata.raw_ref", "cs4Label": "'source_product'",
        "cs4": "concat(coalesce(metadata.product.vendor_name, 'None'), ' ', coalesce(metadata.product.name, 'None'))",
    }
    pairs = ", ".join(f"CASE WHEN {v} <> '' THEN concat('{k}=', {cef_escape_ext(v)}) END" for k, v in ext.items())
    head = "concat_ws('|', " + ", ".join(
        cef_escape_header(x) for x in (q(vendor), q(product), q(version), "CAST(type_uid AS STRING)", "type_name", sev)) + ")"
    return events.withColumn(out, F.expr(f"concat('CEF:0|', {head}, '|', concat_ws(' ', {pairs}))"))


def to_syslog_cef(events: DataFrame, out: str = "line", host: str = "logloom", sent_at: str = "timestamp_millis(time)",
                  **cef) -> DataFrame:
    """CEF in a BSD syslog header, cut to 65000 bytes."""
    df = to_cef(events, "_cef", **cef)
    line = f"concat('<134>', date_format({sent_at}, 'MMM dd HH:mm:ss'), ' ', {q(host)}, ' ', _cef)"
    cut = f"CASE WHEN octet_length({line}) <= 65000 THEN {line} ELSE make_valid_utf8(CAST(substring(CAST({line} AS BINARY), 1, 65000) AS STRING)) END"
    return df.withColumn(out, F.expr(cut)).drop("_cef")


def to_bulk_ndjson(events: DataFrame, index: str = "events") -> DataFrame:
    """(event_id, line_no, line): a create action, then the record with @timestamp."""
    names = ", ".join(f"`{c}`" for c in events.columns)
    action = (f"to_json(named_struct('create', named_struct('_index', concat({q(index + '-')},"
              f" replace(left(time_dt, 10), '-', '.')), '_id', metadata.uid)))")
    doc = f"to_json(struct({names}, time_dt AS `@timestamp`))"
    return events.selectExpr("metadata.uid AS event_id", f"posexplode(array({action}, {doc})) AS (line_no, line)")


def to_kafka_frame(events: DataFrame) -> DataFrame:
    """key = source, value = event JSON; ready for ``.write.format('kafka')``."""
    return events.select(F.col("metadata.source_id").alias("key"),
                         F.to_json(F.struct(*events.columns)).alias("value"))


def fan_out(df: DataFrame, sinks: Mapping[str, Callable[[DataFrame], None]]) -> dict[str, str | None]:
    """Runs every sink on one frame; a failing sink does not stop the others.

    Returns the error of each sink (None when it went well).
    """
    df = df.persist()
    results: dict[str, str | None] = {}
    try:
        for name, sink in sinks.items():
            try:
                sink(df)
                results[name] = None
            except Exception as e:  # noqa: BLE001 - one sink must not stop the rest
                log.warning("sink %s failed: %s", name, e)
                results[name] = str(e)
    finally:
        df.unpersist()
    return results
