"""Queries over quarantine, archive, metrics, sinks, registry and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.sqltext import lookup
from ..operators import archive as arc
from ..operators import dlq, heal, metrics, regression
from ..sources import ingest
from ..operators import registry_log as rl
from ..operators import signature as sig
from ..operators import sinks
from ..plans import pipeline as pl
from ..schema import DISPOSITION
from .oracle import BASE, EVENT
from .parsing import EVENT_COLS, flat, pick, reg

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def events(spark, sf, name: str, *families: int, keep=("eid",)) -> DataFrame:
    return pl.to_events_with(flat(spark, sf, reg(name), *families), *keep)


def outcomes(spark, sf, *families: int) -> DataFrame:
    """(eid, ts, channel, source_id, reason, parser_id) of every line."""
    out = pl.route(fx.raw_events(spark, sf, *families), reg())
    return out.select("eid", "event_id", "ts", "channel", "source_id", "reason", "parser_id")


# ---------------------------------------------------------------- reporting aggregates
@query("agg_by_direction", EVENT + "SELECT disposition, e_dir AS direction, CAST(count(*) AS BIGINT) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM f WHERE family = 6 GROUP BY 1, 2")
def agg_by_direction(spark, sf):
    df = pick(flat(spark, sf, reg("fortigate"), 6))
    return df.groupBy("disposition", "direction").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes_out"))


@query("agg_by_class", EVENT + "SELECT CAST(class_uid AS BIGINT) AS class_uid, severity, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2")
def agg_by_class(spark, sf):
    df = flat(spark, sf, reg()).filter("reason IS NULL")
    return df.groupBy(F.col("class_uid").cast("bigint").alias("class_uid"), "severity").agg(F.count("*").alias("n"))


@query("agg_by_disposition", EVENT + "SELECT vendor, disposition, action, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2, 3")
def agg_by_disposition(spark, sf):
    df = flat(spark, sf, reg()).filter("reason IS NULL")
    return df.groupBy(F.col("metadata__product__vendor_name").alias("vendor"), "disposition", "action").agg(F.count("*").alias("n"))


@query("agg_mode", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) SELECT user_id, event_type, CAST(n AS BIGINT) AS votes FROM r WHERE rn = 1")
def agg_mode(spark, sf):
    return metrics.mode(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "event_type", "event_id")


# ---------------------------------------------------------------- metrics
@query("metrics_totals", BASE + "SELECT CAST(count(*) AS BIGINT) AS total_ingested, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS total_parsed, CAST(count(reason) AS BIGINT) AS total_dlq, "
       "CAST(count(*) FILTER (reason = 'no_parser_match') AS BIGINT) AS no_parser_match, CAST(count(*) FILTER (reason = 'tokenize_failed') AS BIGINT) AS tokenize_failed, "
       "CAST(0 AS BIGINT) AS normalize_error, CAST(0 AS BIGINT) AS schema_violation, round(count(*) FILTER (reason IS NULL) / count(*) * 100, 2) AS parse_success_rate_pct FROM d")
def metrics_totals(spark, sf):
    return metrics.totals(outcomes(spark, sf))


@query("metrics_by_source", BASE + "SELECT COALESCE(sid, CASE WHEN reason = 'tokenize_failed' THEN 'pfsense' ELSE 'unknown@' || channel END) AS source, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS parsed, "
       "CAST(count(reason) AS BIGINT) AS dlq, CAST(max(epoch_us(ts)) AS BIGINT) AS last_us FROM d GROUP BY 1")
def metrics_by_source(spark, sf):
    return metrics.by_source(outcomes(spark, sf)).selectExpr("source", "parsed", "dlq", "unix_micros(last_seen) AS last_us")


_HIST = """, h AS (SELECT date_trunc('hour', ts) AS t, count(*) AS ingested, count(*) FILTER (reason IS NULL) AS parsed, count(reason) AS dlq FROM d GROUP BY 1),
 s AS (SELECT unnest(generate_series((SELECT min(t) FROM h), (SELECT max(t) FROM h), INTERVAL 1 HOUR)) AS t),
 g AS (SELECT s.t, COALESCE(ingested, 0) AS ingested, COALESCE(parsed, 0) AS parsed, COALESCE(dlq, 0) AS dlq FROM s LEFT JOIN h ON s.t = h.t) """


@query("metrics_history", BASE + _HIST + "SELECT CAST(epoch_us(t) // 1000000 AS BIGINT) AS t, CAST(ingested AS BIGINT) AS ingested, CAST(parsed AS BIGINT) AS parsed, CAST(dlq AS BIGINT) AS dlq FROM g")
def metrics_history(spark, sf):
    hist = metrics.history(outcomes(spark, sf), "1 hour", None)
    return hist.selectExpr("unix_seconds(t) AS t", "ingested", "parsed", "dlq")


@query("metrics_eps", BASE + _HIST + "SELECT CAST(epoch_us(t) // 1000000 AS BIGINT) AS t, CAST(COALESCE(sum(ingested) OVER w, 0) AS BIGINT) AS last_sum, CAST(count(ingested) OVER w AS BIGINT) AS last_n FROM g WINDOW w AS (ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def metrics_eps(spark, sf):
    raw = fx.base(spark, sf).selectExpr("ts", "CAST(NULL AS STRING) AS reason")
    return metrics.events_per_bucket(metrics.history(raw, "1 hour", None), bucket="1 hour").selectExpr(
        "unix_seconds(t) AS t", "last_sum", "last_n")


@query("recent_events", EVENT + "SELECT eid, CAST(class_uid AS BIGINT) AS class_uid, CAST(time_ms AS BIGINT) AS time_ms FROM f WHERE sid = 'fortigate' ORDER BY time_ms DESC, eid DESC LIMIT 50")
def recent_events(spark, sf):
    df = flat(spark, sf, reg("fortigate"), 6).filter("reason IS NULL")
    rows = df.selectExpr("eid AS event_id", "metadata__source_id AS source_id", "CAST(class_uid AS BIGINT) AS class_uid", "time")
    return metrics.recent_events(rows, 50, "fortigate", 4001).selectExpr("event_id AS eid", "class_uid", "time AS time_ms")


# ---------------------------------------------------------------- signatures and quarantine
_SIG = BASE + """, g AS (SELECT *, CASE WHEN family = 10 THEN k % 4 WHEN k % 2 = 0 THEN 4 ELSE 5 END AS sub FROM d WHERE family IN (10, 11)),
 s AS (SELECT *, CASE sub
   WHEN 0 THEN 'kv:id,sn,time,fw' WHEN 1 THEN 'app=RT_FLOW|text:RT_FLOW_SESSION_DENY: session denied <*>'
   WHEN 2 THEN 'json:CommandLine,ComputerName,ImageFileName,RawProcessId,UserName,aid,event_simpleName,timestamp,vendor'
   WHEN 3 THEN 'app=filterlog|csv:26' WHEN 4 THEN 'text:<*> <kv> <*>' ELSE 'app=filterlog|text:SOMETHING_NEW <kv>' END AS key,
  CASE sub WHEN 0 THEN 'key=value {id, sn, time, fw, …}' WHEN 1 THEN 'RT_FLOW: RT_FLOW_SESSION_DENY: session denied <*>'
   WHEN 2 THEN 'JSON {CommandLine, ComputerName, ImageFileName, RawProcessId, UserName, …}' WHEN 3 THEN 'filterlog: CSV (26 columns)'
   WHEN 4 THEN '<*> <kv> <*>' ELSE 'filterlog: SOMETHING_NEW <kv>' END AS label,
  CASE sub WHEN 0 THEN 'kv' WHEN 2 THEN 'json' WHEN 3 THEN 'csv' ELSE 'text' END AS fmt FROM g),
 q AS (SELECT *, substr(sha1(channel || '|' || key), 1, 12) AS cluster_id FROM s) """


@query("sig_format", _SIG + "SELECT eid, cluster_id, label AS cluster_label, fmt AS format_guess FROM q")
def sig_format(spark, sf):
    return sig.signature(fx.lines(spark, sf, 10, 11)).select("eid", "cluster_id", "cluster_label", "format_guess")


@query("sig_cluster_counts", _SIG + "SELECT cluster_id, fmt AS format_guess, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1, 2")
def sig_cluster_counts(spark, sf):
    return sig.signature(fx.lines(spark, sf, 10, 11)).groupBy("cluster_id", "format_guess").agg(F.count("*").alias("n"))


_TOK = "regexp_matches(t, '^[-+]?[0-9]+([.,:][0-9]+)*$')"


@query("sig_shape", "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:4] AS ws FROM conversations), t AS (SELECT conv_id, turn, unnest(ws) AS t FROM w) "
       "SELECT shape, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN regexp_matches(t, '^[0-9]{1,3}(\\.[0-9]{1,3}){3}([:/][0-9]+)*$') THEN '<ip>' WHEN " + _TOK + " THEN '<num>' "
       "WHEN regexp_matches(t, '^(0x)?[0-9a-fA-F]{8,}$') THEN '<hex>' WHEN contains(t, '=') THEN '<kv>' WHEN length(t) <= 40 AND regexp_matches(t, '^[A-Za-z%_][\\p{L}\\p{N}_%\\-]*:?$') "
       "THEN regexp_replace(t, '\\p{Nd}', '#', 'g') ELSE '<*>' END AS shape FROM t) GROUP BY 1")
def sig_shape(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "conv_id", "turn", "explode(slice(filter(split(text, '\\\\s+'), w -> w <> ''), 1, 4)) AS t")
    return df.groupBy(F.expr(sig.shape_sql("t")).alias("shape")).agg(F.count("*").alias("n"))


def dlq_table(spark, sf) -> DataFrame:
    """Quarantined lines of the drift and garbage families, through the whole parser set."""
    raw = fx.raw_events(spark, sf, 10, 11)
    _, rows = pl.parse_or_quarantine(raw, reg())
    return rows


@query("dlq_rows", _SIG + "SELECT cluster_id, reason, CASE WHEN reason = 'tokenize_failed' THEN 'pfsense' END AS parser_id, "
       "CASE WHEN reason = 'tokenize_failed' THEN 'tokenize_failed: no tokenize pattern matched' ELSE 'no_parser_match: no fingerprint matched' END AS error, channel, CAST(epoch_us(ts) + 1000000 AS BIGINT) AS ts_us, 'pending' AS status FROM q")
def dlq_rows(spark, sf):
    return dlq_table(spark, sf).selectExpr("cluster_id", "reason", "parser_id", "error", "channel", "unix_micros(ts) AS ts_us", "status")


def light_dlq(spark, sf) -> DataFrame:
    """The same rows from signatures alone (the reason is known by construction)."""
    df = sig.signature(fx.raw_events(spark, sf, 10, 11))
    return df.selectExpr(
        "eid", "event_id", "channel", "source_hint", "left(text, 4000) AS raw_snippet",
        "CASE WHEN (family = 10 AND k % 4 = 3) OR (family = 11 AND k % 2 = 1) THEN 'tokenize_failed' ELSE 'no_parser_match' END AS reason",
        "CASE WHEN (family = 10 AND k % 4 = 3) OR (family = 11 AND k % 2 = 1) THEN 'pfsense' END AS parser_id",
        "cluster_id", "cluster_label", "format_guess", "raw_ref", "sha256 AS raw_sha256", "ingest_time", "ts", "'pending' AS status", "k", "text")


@query("dlq_clusters", _SIG + ", n AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, eid DESC) AS rn FROM q) SELECT cluster_id, channel, max(label) AS label, CAST(count(*) AS BIGINT) AS count, "
       "CAST(min(epoch_us(ts)) AS BIGINT) AS first_us, CAST(max(epoch_us(ts)) AS BIGINT) AS last_us, max(reason) AS reasons, max(CASE WHEN reason = 'tokenize_failed' THEN 'pfsense' ELSE '' END) AS parser_ids, "
       "CAST(least(count(*), 3) AS BIGINT) AS samples FROM n GROUP BY 1, 2")
def dlq_clusters(spark, sf):
    df = dlq.pending_clusters(light_dlq(spark, sf))
    return df.selectExpr("cluster_id", "channel", "label", "count", "unix_micros(first_ts) AS first_us", "unix_micros(last_ts) AS last_us",
                         "array_join(reasons, ',') AS reasons", "array_join(parser_ids, ',') AS parser_ids",
                         "CAST(size(samples) AS BIGINT) AS samples")


@query("dlq_cluster_samples", _SIG + "SELECT cluster_id, eid, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, eid DESC) AS rn FROM q) WHERE rn <= 25")
def dlq_cluster_samples(spark, sf):
    return dlq.last_k(light_dlq(spark, sf), "cluster_id", ["ts", "eid"], 25).selectExpr("cluster_id", "eid", "CAST(rank AS BIGINT) AS rank")


def status_log(rows: DataFrame) -> DataFrame:
    """Decisions derived from the table: some rows replayed, some dismissed, one of them twice."""
    first = rows.filter("k % 3 = 0").selectExpr("event_id", "cluster_id", "CASE WHEN k % 2 = 0 THEN 'replayed' ELSE 'dismissed' END AS status",
                                                "ts + INTERVAL 1 HOUR AS at")
    back = rows.filter("k % 9 = 0").selectExpr("event_id", "cluster_id", "'pending' AS status", "ts + INTERVAL 2 HOUR AS at")
    return first.unionByName(back)


_ST = "CASE WHEN k % 9 = 0 THEN 'pending' WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'replayed' ELSE 'dismissed' END ELSE 'pending' END"


@query("dlq_status_log", BASE + f"SELECT eid, {_ST} AS status FROM d WHERE family >= 10")
def dlq_status_log(spark, sf):
    rows = light_dlq(spark, sf)
    return dlq.current_status(rows, status_log(rows)).select("eid", "status")


@query("dlq_status_counts", BASE + f"SELECT {_ST} AS status, CAST(count(*) AS BIGINT) AS n FROM d WHERE family >= 10 GROUP BY 1")
def dlq_status_counts(spark, sf):
    rows = light_dlq(spark, sf)
    return dlq.status_counts(dlq.current_status(rows, status_log(rows)))


@query("set_pending", BASE + f"SELECT eid FROM d WHERE family >= 10 AND {_ST} = 'pending'")
def set_pending(spark, sf):
    rows = light_dlq(spark, sf)
    return dlq.pending(rows, status_log(rows)).select("eid")


@query("dlq_latest_by_event", "SELECT user_id, event_id AS eid, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def dlq_latest_by_event(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "event_id AS eid", "event_type")
    return dlq.latest(df, "user_id", "eid")


@query("dlq_recent", BASE + "SELECT eid, reason FROM d WHERE family >= 10 ORDER BY ts DESC, eid DESC LIMIT 50")
def dlq_recent(spark, sf):
    rows = light_dlq(spark, sf).drop("event_id").withColumnRenamed("eid", "event_id")
    return dlq.recent(rows, 50, "pending").selectExpr("event_id AS eid", "reason")


# ---------------------------------------------------------------- archive, audit, replay
def doc_archive(spark, sf, tamper: bool = True) -> DataFrame:
    """Whole document texts as archived originals; some stored hashes or bytes are tampered with."""
    df = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id", "doc_id AS event_id", "CAST(text AS BINARY) AS raw", "source AS source_hint", "timestamp'2024-01-01 05:06:07' AS ingest_time",
        "'http' AS channel")
    df = df.selectExpr("*", "sha2(raw, 256) AS sha256", "concat('local://', source_hint, '/', doc_id) AS raw_ref",
                       "CAST(octet_length(raw) AS BIGINT) AS size_bytes")
    if tamper:
        df = df.withColumn("raw", F.expr("CASE WHEN doc_id % 7 = 0 THEN concat(raw, X'21') ELSE raw END"))
    return df


def doc_events(spark, sf) -> DataFrame:
    df = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 5 <> 0")
    return df.selectExpr("doc_id AS event_id", "CASE WHEN doc_id % 11 = 0 THEN repeat('0', 64) ELSE sha2(text, 256) END AS raw_sha256",
                         "source AS source_id")


@query("sink_archive_ref", "SELECT doc_id, 'local://' || source || '/' || doc_id AS raw_ref, source, '2024010105' AS ingest_hour, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents")
def sink_archive_ref(spark, sf):
    return arc.archive_rows(doc_archive(spark, sf, False)).selectExpr("event_id AS doc_id", "raw_ref", "source", "ingest_hour", "size_bytes", "sha256")


@query("audit_verify", "SELECT doc_id, doc_id % 7 <> 0 AS verified, CASE WHEN doc_id % 5 = 0 THEN TRUE ELSE doc_id % 11 <> 0 AND doc_id % 7 <> 0 END AS link_ok FROM documents")
def audit_verify(spark, sf):
    return arc.audit(doc_archive(spark, sf), doc_events(spark, sf)).selectExpr("event_id AS doc_id", "verified", "link_ok")


@query("audit_tamper_counts", "SELECT source, CAST(count(*) FILTER (doc_id % 7 = 0) AS BIGINT) AS tampered, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def audit_tamper_counts(spark, sf):
    df = arc.verify(doc_archive(spark, sf))
    return df.groupBy(F.col("source_hint").alias("source")).agg(F.count_if(~F.col("verified")).alias("tampered"), F.count("*").alias("n"))


@query("audit_trace", "SELECT doc_id, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS raw_hash FROM documents WHERE doc_id % 5 <> 0")
def audit_trace(spark, sf):
    return arc.trace(doc_events(spark, sf), doc_archive(spark, sf)).selectExpr("event_id AS doc_id", "sha2(raw, 256) AS raw_hash")


@query("audit_lookup", BASE + "SELECT eid, CASE WHEN family <= 9 THEN 'normalized' WHEN family = 10 THEN 'dlq' END AS status, sid AS source_id, CASE WHEN family = 10 THEN reason END AS reason FROM d")
def audit_lookup(spark, sf):
    out = outcomes(spark, sf)
    ids = fx.raw_events(spark, sf).select("eid", "event_id")
    bad = light_dlq(spark, sf).filter("eid % 12 = 10").select("event_id", "reason")
    return arc.find_event(ids, out.filter("reason IS NULL"), bad).select("eid", "status", "source_id", "reason")


@query("replay_source", BASE + "SELECT eid, k % 4 <> 0 AS from_archive, CASE WHEN k % 4 <> 0 OR k % 8 = 0 THEN sha256(line) END AS sha256 FROM (SELECT eid, k, '###UNKNOWN### code=' || user_id || ' x~~y' || CASE WHEN k % 8 = 4 THEN repeat('z', 5000) ELSE '' END AS line FROM d)")
def replay_source(spark, sf):
    """Every line of the table; a quarter isn't archived, and of half of those the snippet is only a part."""
    raw = ingest.mint_ids(fx.base(spark, sf).selectExpr(
        "eid", "k", "channel", "CAST(concat('###UNKNOWN### code=', user_id, ' x~~y', if(k % 8 = 4, repeat('z', 5000), '')) AS BINARY) AS raw"), "eid")
    rows = raw.selectExpr("eid", "event_id", "left(CAST(raw AS STRING), 4000) AS raw_snippet")
    return arc.replay_source(rows, raw.filter("k % 4 <> 0")).selectExpr("eid", "from_archive", "sha2(raw, 256) AS sha256")


DRIFT_FIX = {
    "source_id": "edr_agent", "version": "v1", "fingerprint": {"type": "json_key", "key": "vendor", "value": "edr_agent"},
    "tokenize": {"type": "json"}, "ocsf": {"class_uid": 1007, "activity": "Launch"}, "product": {"name": "edr", "vendor_name": "edr"},
    "mapping": {"fields": {"CommandLine": "process.cmd_line", "UserName": "actor.user.name", "RawProcessId": "process.pid",
                           "ComputerName": "device.hostname"}, "timestamp": {"source": "timestamp", "format": "epoch_ms"}},
}


@query("replay_summary", _SIG + "SELECT cluster_id, CAST(count(*) AS BIGINT) AS attempted, CAST(count(*) FILTER (sub = 2) AS BIGINT) AS parsed, CAST(count(*) FILTER (sub <> 2) AS BIGINT) AS still_failing FROM q GROUP BY 1")
def replay_summary(spark, sf):
    rows = light_dlq(spark, sf).drop("text")
    archive = fx.raw_events(spark, sf, 10, 11).select("event_id", "raw")
    out = pl.replay(rows, archive, reg("pfsense").overlay(DRIFT_FIX))
    return out.groupBy("cluster_id").agg(F.count("*").alias("attempted"), F.count_if(F.col("still").isNull()).alias("parsed"),
                                         F.count("still").alias("still_failing"))


# ---------------------------------------------------------------- sinks
@query("sink_flatten", EVENT + "SELECT eid, CAST(class_uid AS BIGINT) AS class_uid, e_src AS \"src_endpoint.ip\", CAST(e_dport AS BIGINT) AS \"dst_endpoint.port\", 'FGT' AS \"device.hostname\", 'Fortinet' AS \"metadata.product.vendor_name\", e_dir AS \"connection_info.direction\" FROM f WHERE family = 6")
def sink_flatten(spark, sf):
    out = sinks.flatten_columns(events(spark, sf, "fortigate", 6))
    cols = ["src_endpoint.ip", "device.hostname", "metadata.product.vendor_name", "connection_info.direction"]
    return out.select("eid", F.col("class_uid").cast("bigint").alias("class_uid"), F.col("`dst_endpoint.port`").cast("bigint").alias("dst_endpoint.port"),
                      *[F.col(f"`{c}`") for c in cols])


@query("sink_features", EVENT + "SELECT CAST(time_ms AS BIGINT) AS time_ms, sid AS source_id, vendor, CAST(class_uid AS BIGINT) AS class_uid, CAST(activity_id AS BIGINT) AS activity_id, CAST(severity_id AS BIGINT) AS severity_id, "
       "CAST(action_id AS BIGINT) AS action_id, CAST(disposition_id AS BIGINT) AS disposition_id, e_src AS src_ip, e_dst AS dst_ip, CAST(e_sport AS BIGINT) AS src_port, CAST(e_dport AS BIGINT) AS dst_port, CAST(e_num AS BIGINT) AS protocol_num, "
       "CAST(e_dir_id AS BIGINT) AS direction_id, CAST(e_in AS BIGINT) AS bytes_in, CAST(e_out AS BIGINT) AS bytes_out, CASE WHEN e_src IS NOT NULL THEN src_int END AS src_is_internal, CASE WHEN e_dst IS NOT NULL THEN dst_int END AS dst_is_internal, "
       "e_dport IN (21,3389,445) AS dst_port_risky, COALESCE(action_id = 2, FALSE) AS is_blocked, class_uid = 2004 AS is_finding FROM f")
def sink_features(spark, sf):
    return sinks.feature_table(pl.normalize(fx.raw_events(spark, sf), reg())).drop("uid", "raw_sha256")


_CEF = ("'CEF:0|Logloom|Log normalizer|1.0.0|' || (class_uid * 100 + activity_id) || '|' || class_name || ': ' || activity_name || '|' || CASE severity_id WHEN 1 THEN 1 WHEN 3 THEN 5 END || '|rt=' || time_ms || "
        "' src=' || e_src || ' spt=' || e_sport || ' dst=' || e_dst || ' dpt=' || e_dport || ' proto=' || e_proto || ' act=' || disposition || ' cs1Label=event_uid'")


@query("sink_cef", EVENT + f"SELECT eid, {_CEF} AS head, ' cs4Label=source_product cs4=Fortinet FortiGate' AS tail FROM f WHERE family = 6")
def sink_cef(spark, sf):
    out = sinks.to_cef(events(spark, sf, "fortigate", 6))
    return out.selectExpr("eid", "substring_index(cef, ' cs1=', 1) AS head", "substr(cef, instr(cef, ' cs4Label=')) AS tail")


@query("sink_syslog_cef", EVENT + f"SELECT eid, '<134>' || bsd || ' logloom ' || {_CEF} AS head FROM f WHERE family = 6")
def sink_syslog_cef(spark, sf):
    out = sinks.to_syslog_cef(events(spark, sf, "fortigate", 6))
    return out.selectExpr("eid", "substring_index(line, ' cs1=', 1) AS head")


@query("sink_bulk", EVENT + "SELECT CAST(0 AS BIGINT) AS line_no, 'logs-' || strftime(ts, '%Y.%m.%d') AS idx, CAST(NULL AS VARCHAR) AS src_ip, CAST(count(*) AS BIGINT) AS n FROM f WHERE family = 6 GROUP BY 2 "
       "UNION ALL SELECT 1, NULL, e_src, CAST(count(*) AS BIGINT) FROM f WHERE family = 6 GROUP BY 3")
def sink_bulk(spark, sf):
    out = sinks.to_bulk_ndjson(events(spark, sf, "fortigate", 6, keep=()), "logs")
    rows = out.selectExpr("CAST(line_no AS BIGINT) AS line_no", "get_json_object(line, '$.create._index') AS idx",
                          "get_json_object(line, '$.src_endpoint.ip') AS src_ip")
    return rows.groupBy("line_no", "idx", "src_ip").agg(F.count("*").alias("n"))


@query("sink_kafka_frame", EVENT + "SELECT sid AS key, e_src AS src_ip, disposition, CAST(count(*) AS BIGINT) AS n FROM f WHERE family = 6 GROUP BY 1, 2, 3")
def sink_kafka_frame(spark, sf):
    out = sinks.to_kafka_frame(events(spark, sf, "fortigate", 6, keep=()))
    return out.groupBy("key", F.expr("get_json_object(value, '$.src_endpoint.ip')").alias("src_ip"),
                       F.expr("get_json_object(value, '$.disposition')").alias("disposition")).agg(F.count("*").alias("n"))


@query("set_union_sources", EVENT + "SELECT sid AS source_id, CAST(count(*) AS BIGINT) AS n, CAST(count(e_dst) AS BIGINT) AS with_dst FROM f WHERE family IN (4, 6) GROUP BY 1")
def set_union_sources(spark, sf):
    a, b = events(spark, sf, "fortigate", 6), events(spark, sf, "squid", 4).drop("dst_endpoint")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy(F.col("metadata.source_id").alias("source_id")).agg(F.count("*").alias("n"), F.count("dst_endpoint.ip").alias("with_dst"))


@query("src_lake", EVENT + "SELECT eid, e_src AS src_ip, CAST(time_ms AS BIGINT) AS time_ms FROM f WHERE family = 6 AND strftime(ts, '%d') = '02'")
def src_lake(spark, sf):
    """Events with their lake partitions, cut to one source and one day."""
    lake = sinks.with_partitions(events(spark, sf, "fortigate", 6))
    return lake.filter("source_id = 'fortigate' AND day = '2024-01-02'").selectExpr("eid", "src_endpoint.ip AS src_ip", "time AS time_ms")


# ---------------------------------------------------------------- registry
def registry_events(spark, sf) -> DataFrame:
    """A version log derived from events: every user is a source, types decide the action."""
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "concat('src', user_id) AS source_id", "event_id AS seq", "concat('v', event_id) AS version",
        "CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'promote' WHEN event_type = 'error' THEN 'rollback' ELSE 'note' END AS action")


_LIVE = """WITH l AS (SELECT 'src' || user_id AS source_id, event_id AS seq, 'v' || event_id AS version,
  CASE WHEN event_type IN ('purchase','view','click') THEN -1 WHEN event_type = 'error' THEN 1 ELSE 0 END AS step FROM events),
 a AS (SELECT *, sum(step) OVER (PARTITION BY source_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS s FROM l),
 m AS (SELECT *, min(s) OVER (PARTITION BY source_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM a),
 v AS (SELECT source_id, version, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM m WHERE step = -1 AND s < least(COALESCE(h, 0), 0)) """


@query("registry_current", _LIVE + "SELECT source_id, version FROM v WHERE rn = 1")
def registry_current(spark, sf):
    return rl.current(registry_events(spark, sf)).select("source_id", "version")


@query("registry_rollback", _LIVE + "SELECT source_id, version FROM v WHERE rn = 2")
def registry_rollback(spark, sf):
    return rl.previous(registry_events(spark, sf)).select("source_id", "version")


@query("registry_overlay", "SELECT 'src' || user_id AS source_id, CASE WHEN user_id % 3 = 0 THEN 'candidate' ELSE 'live' END AS origin FROM (SELECT DISTINCT user_id FROM events)")
def registry_overlay(spark, sf):
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct()
    live = users.selectExpr("concat('src', user_id) AS source_id", "'live' AS origin")
    cand = users.filter("user_id % 3 = 0").selectExpr("concat('src', user_id) AS source_id", "'candidate' AS origin")
    return rl.overlay(live, cand)


@query("registry_errors", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'missing required key ''fingerprint''' WHEN 1 THEN 'unknown fingerprint type: magic' WHEN 2 THEN 'unknown tokenize type: yaml' ELSE 'missing required key ''mapping''' END AS error FROM events WHERE event_id % 5 < 4")
def registry_errors(spark, sf):
    defs = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", "concat('p', event_id) AS source_id", "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'magic' ELSE 'regex' END AS fingerprint",
        "CASE event_id % 5 WHEN 2 THEN 'yaml' ELSE 'kv' END AS tokenizer", "CASE event_id % 5 WHEN 3 THEN NULL ELSE 'm' END AS mapping")
    return rl.definition_errors(defs).select("event_id", "error")


@query("registry_report", BASE + "SELECT source_id, CAST(COALESCE(parsed, 0) AS BIGINT) AS parsed, CAST(COALESCE(dlq, 0) AS BIGINT) AS dlq FROM (SELECT unnest(['suricata','suricata_eve','cisco_asa','fortigate','paloalto','pfsense','squid','generic_cef','generic_leef','generic_cef_base']) AS source_id) r "
       "LEFT JOIN (SELECT COALESCE(sid, CASE WHEN reason = 'tokenize_failed' THEN 'pfsense' ELSE 'unknown' END) AS s, count(*) FILTER (reason IS NULL) AS parsed, count(reason) AS dlq FROM d GROUP BY 1) ON s = source_id")
def registry_report(spark, sf):
    return rl.report(reg().to_frame(spark), metrics.by_source(outcomes(spark, sf))).select("source_id", "parsed", "dlq")


@query("aware_overlap", BASE + "SELECT CAST(family AS BIGINT) AS family, source_id, CAST(count(*) AS BIGINT) AS hits FROM (SELECT family, unnest(CASE family WHEN 2 THEN ['suricata','suricata_eve'] WHEN 8 THEN ['generic_cef','generic_cef_base'] "
       "WHEN 10 THEN CASE WHEN k % 4 = 3 THEN ['pfsense'] ELSE [] END WHEN 11 THEN CASE WHEN k % 2 = 1 THEN ['pfsense'] ELSE [] END ELSE [sid] END) AS source_id FROM d) GROUP BY 1, 2")
def aware_overlap(spark, sf):
    return rl.fingerprint_overlap(fx.lines(spark, sf), reg(), "family").selectExpr("CAST(family AS BIGINT) AS family", "source_id", "hits")


def corpus(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every line of every family as a corpus; what each file expects, from the table."""
    rows = fx.lines(spark, sf).selectExpr("concat('f', family, if(family = 8 AND k % 5 = 0, 'b', '')) AS file", "eid AS line_no", "text", "ingest_time", "channel AS ch", "family", "k")
    names = {**{str(f): s for f, s in fx.FAMILIES.items()}}
    exp = rows.groupBy("file").agg(F.min("ch").alias("channel"), F.first("family").alias("family"))
    sid = f"CASE WHEN file = 'f8b' THEN 'generic_cef_base' ELSE {lookup(names, 'CAST(family AS STRING)')} END"
    cls = "CASE WHEN family = 2 THEN 2004 WHEN family = 4 THEN 4002 WHEN file = 'f8b' THEN 0 WHEN family = 6 THEN 4002 WHEN family <= 9 THEN 4001 END"
    return rows.drop("ch", "family", "k"), exp.selectExpr("file", f"{sid} AS source_id", "channel", f"{cls} AS class_uid")


@query("regression_gate", BASE + "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (family = 6) AS BIGINT) AS failed, count(*) FILTER (family = 6) = 0 AS passed FROM d")
def regression_gate(spark, sf):
    """One expectation is wrong on purpose (class of family 6), so the gate must refuse."""
    lines, exp = corpus(spark, sf)
    return regression.gate(regression.check(lines, exp, reg()))


@query("join_broadcast_lookup", "SELECT event_id, CASE event_type WHEN 'error' THEN 'Blocked' WHEN 'signup' THEN 'Dropped' WHEN 'view' THEN 'Allowed' ELSE event_type END AS disposition FROM events")
def join_broadcast_lookup(spark, sf):
    """A value table as a TABLE: the optimizer broadcasts it while it is small, and shuffles it beyond."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    table = ev.select("event_type").distinct().selectExpr(
        "event_type", "CASE event_type WHEN 'error' THEN 'Blocked' WHEN 'signup' THEN 'Dropped' WHEN 'view' THEN 'Allowed' END AS mapped").filter("mapped IS NOT NULL")
    return ev.join(table, "event_type", "left").selectExpr("event_id", "coalesce(mapped, event_type) AS disposition")


# ---------------------------------------------------------------- proposals
def proposals(spark, sf) -> DataFrame:
    """A proposal log derived from the quarantine itself: two per cluster, status by cluster hash."""
    rows = light_dlq(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    both = rows.selectExpr("*", "explode(array(1, 2)) AS id")
    return both.selectExpr(
        "CAST(id AS BIGINT) AS id", "cluster_id", "last - make_interval(0, 0, 0, 10 * (3 - id)) AS created_at", "last - make_interval(0, 0, 0, 5) AS updated_at",
        "n - 6 AS pending_at_creation", "CASE WHEN id = 1 THEN 'dismissed' WHEN left(cluster_id, 1) < '4' THEN 'open' WHEN left(cluster_id, 1) < '8' THEN 'promoted' ELSE 'dismissed' END AS status")


_PROP = _SIG + ", p AS (SELECT cluster_id, count(*) AS n, max(ts) AS last, CASE WHEN left(cluster_id, 1) < '4' THEN 'open' WHEN left(cluster_id, 1) < '8' THEN 'promoted' ELSE 'dismissed' END AS status FROM q GROUP BY 1) "


@query("heal_latest_proposal", _PROP + "SELECT cluster_id, CAST(n AS BIGINT) AS count, CAST(2 AS BIGINT) AS proposal_id, status FROM p")
def heal_latest_proposal(spark, sf):
    clusters = light_dlq(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("count"))
    return heal.latest_proposal(clusters, proposals(spark, sf)).selectExpr("cluster_id", "count", "p_id AS proposal_id", "p_status AS status")


@query("heal_pending_since", _PROP + "SELECT q.cluster_id, CAST(count(*) AS BIGINT) AS new_n, CAST(min(epoch_us(ts)) AS BIGINT) AS first_us FROM q JOIN p ON q.cluster_id = p.cluster_id WHERE p.status <> 'open' AND ts > last - INTERVAL 5 DAY GROUP BY 1")
def heal_pending_since(spark, sf):
    return heal.pending_since(light_dlq(spark, sf), proposals(spark, sf)).selectExpr("cluster_id", "new_n", "unix_micros(new_first_ts) AS first_us")


@query("heal_states", _PROP + ", cc AS (SELECT q.cluster_id, any_value(p.status) AS status, count(*) AS n, count(*) FILTER (ts > last - INTERVAL 5 DAY) AS fresh FROM q JOIN p ON q.cluster_id = p.cluster_id GROUP BY 1) "
       "SELECT cluster_id, status AS latest_proposal_status, CAST(n AS BIGINT) AS count, CAST(CASE WHEN status = 'open' THEN n ELSE fresh END AS BIGINT) AS counted, "
       "CASE WHEN status = 'open' THEN 'refresh' WHEN fresh < 5 THEN 'waiting_min' ELSE 'ready' END AS state FROM cc")
def heal_states(spark, sf):
    rows = light_dlq(spark, sf)
    clusters = rows.groupBy("cluster_id").agg(F.count("*").alias("count"), F.min("ts").alias("first_ts"))
    out = heal.decide(clusters, rows, proposals(spark, sf), "2024-02-15 00:00:00")
    return out.select("cluster_id", "latest_proposal_status", "count", "counted", "state")


@query("heal_match_rate", _SIG + "SELECT cluster_id, CAST(count(*) FILTER (sub = 2) AS BIGINT) AS parsed, CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (sub = 2) / count(*), 3) AS match_rate FROM q GROUP BY 1")
def heal_match_rate(spark, sf):
    raw = fx.raw_events(spark, sf, 10, 11)
    tried = heal.score_candidate(raw, DRIFT_FIX, "edr_agent")
    ids = light_dlq(spark, sf).select("event_id", "cluster_id")
    return heal.match_rate(tried.join(ids, "event_id"), ("cluster_id",))


@query("heal_proposal_current", "WITH s AS (SELECT event_id // 3 AS id, (event_id // 3) % 50 AS cluster, max_by(event_type, event_id) AS t FROM events GROUP BY 1, 2), m AS (SELECT cluster, max(id) AS newest FROM s GROUP BY 1) "
       "SELECT id, CASE WHEN t IN ('view','click','signup') THEN CASE WHEN id < newest THEN 'superseded' ELSE 'open' END WHEN t = 'purchase' THEN 'promoted' ELSE 'dismissed' END AS status FROM s JOIN m USING (cluster)")
def heal_proposal_current(spark, sf):
    log = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id DIV 3 AS id", "concat('c', (event_id DIV 3) % 50) AS cluster_id", "event_id AS seq",
        "CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'open' WHEN event_type = 'purchase' THEN 'promoted' ELSE 'dismissed' END AS status")
    return heal.proposal_current(log).select("id", "status")


@query("heal_drift_parent", _SIG + "SELECT cluster_id, 'pfsense' AS parser_id, CAST(count(*) AS BIGINT) AS votes FROM q WHERE reason = 'tokenize_failed' GROUP BY 1")
def heal_drift_parent(spark, sf):
    failed = light_dlq(spark, sf).filter("reason IN ('tokenize_failed', 'schema_violation', 'normalize_error')")
    return metrics.mode(failed, "cluster_id", "parser_id", "eid")


# ---------------------------------------------------------------- scalar functions
@query("fn_hash", "SELECT doc_id, sha256(text) AS sha256, substr(sha1(text), 1, 12) AS sha1_12 FROM documents")
def fn_hash(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "sha2(text, 256) AS sha256", "left(sha1(text), 12) AS sha1_12")


@query("fn_epoch", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso, CAST(epoch_us(ts) AS BIGINT) AS back_us FROM events")
def fn_epoch(spark, sf):
    from ..functions import timeparse as tp
    df = fx.base(spark, sf).selectExpr("eid AS event_id", "unix_micros(ts) AS us")
    df = df.selectExpr("event_id", f"{tp.millis('us')} AS ms", f"{tp.iso_text('us')} AS iso")
    return df.selectExpr("event_id", "ms", "iso", f"{tp.iso_us('iso')} AS back_us")


@query("fn_norm_name", "SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(url, '^.*\\.', ''), '^.*@', '')), '[^a-z0-9]', '', 'g') AS norm, substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS slug FROM pages")
def fn_norm_name(spark, sf):
    from ..operators.infer import norm_name, slug
    return spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", f"{norm_name('url')} AS norm", f"{slug('url')} AS slug")


@query("fn_cef_escape", "SELECT doc_id, sha256(replace(replace(text || '|a\\b=c', '\\', '\\\\'), '|', '\\|')) AS header, sha256(replace(replace(replace(text || '|a\\b=c', '\\', '\\\\'), '=', '\\='), chr(10), '\\n')) AS ext FROM documents")
def fn_cef_escape(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "concat(text, '|a\\\\b=c') AS t")
    return df.selectExpr("doc_id", f"sha2({sinks.cef_escape_header('t')}, 256) AS header", f"sha2({sinks.cef_escape_ext('t')}, 256) AS ext")


@query("fn_raw_ref", "SELECT event_id, 's' || user_id AS source, CAST(event_id AS VARCHAR) AS ref_id FROM events")
def fn_raw_ref(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", "concat('local://s', user_id, '/', if(event_id % 2 = 0, '2024010105.seg@12#', ''), event_id) AS raw_ref")
    source, uid = arc.parse_ref()
    return df.select("event_id", source.alias("source"), uid.alias("ref_id"))


@query("fn_ip_shapes", "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS t FROM documents) SELECT doc_id, CAST(count(*) FILTER (regexp_matches(t, '^([0-9]{1,3}\\.){3}[0-9]{1,3}$|^[0-9a-fA-F:]*:[0-9a-fA-F:]+$')) AS BIGINT) AS ips, "
       "CAST(count(*) FILTER (regexp_matches(t, '^([0-9]{1,3}\\.){3}[0-9]{1,3}[:/][0-9]{1,5}([:/]\\S+)?$')) AS BIGINT) AS ip_ports, CAST(count(*) FILTER (regexp_matches(t, '^[0-9]+$')) AS BIGINT) AS ints FROM w WHERE t <> '' GROUP BY 1")
def fn_ip_shapes(spark, sf):
    from ..operators import infer
    words = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "explode(split(text, '\\\\s+')) AS t").filter("t <> ''")
    return words.groupBy("doc_id").agg(F.count_if(F.expr(infer.is_ip("t"))).alias("ips"), F.count_if(F.expr(infer.is_ip_port("t"))).alias("ip_ports"),
                                       F.count_if(F.expr(infer.is_int("t"))).alias("ints"))
