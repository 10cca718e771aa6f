"""Queries over sources, envelopes, tokenizers, routing, normalization, enrichment, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import ip as ipf
from ..functions import timeparse as tp
from ..operators import enrich, envelope, tokenizers as tk, validate as val
from ..operators import fingerprint as fp
from ..plans import pipeline as pl
from ..plans.registry import Registry
from ..sources import ingest
from .oracle import BASE, EVENT

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def reg(*ids: str) -> Registry:
    full = Registry.load()
    return full.only(*ids) if ids else full


def flat(spark, sf, registry: Registry, *families: int, **kw) -> DataFrame:
    return pl.parse_flat(fx.raw_events(spark, sf, *families), registry, **kw)


EVENT_COLS = {
    "class_uid": "class_uid", "activity_id": "activity_id", "activity_name": "activity_name",
    "severity_id": "severity_id", "disposition": "disposition", "disposition_id": "disposition_id",
    "action_id": "action_id", "src_ip": "src_endpoint__ip", "src_port": "src_endpoint__port",
    "dst_ip": "dst_endpoint__ip", "dst_port": "dst_endpoint__port",
    "protocol_name": "connection_info__protocol_name", "protocol_num": "connection_info__protocol_num",
    "direction": "connection_info__direction", "time_ms": "time", "bytes_out": "traffic__bytes_out",
    "bytes_in": "traffic__bytes_in", "source_id": "metadata__source_id", "vendor": "metadata__product__vendor_name",
}
_LONGS = {"class_uid", "activity_id", "severity_id", "disposition_id", "action_id", "src_port", "dst_port",
          "protocol_num", "time_ms", "bytes_out", "bytes_in"}


def pick(df: DataFrame, *names: str) -> DataFrame:
    out = []
    for n in names or EVENT_COLS:
        c = F.col(EVENT_COLS[n])
        out.append((c.cast("bigint") if n in _LONGS else c).alias(n))
    return df.filter("reason IS NULL").select("eid", *out)


_ORACLE_COLS = {
    "class_uid": "CAST(class_uid AS BIGINT)", "activity_id": "CAST(activity_id AS BIGINT)",
    "activity_name": "activity_name", "severity_id": "CAST(severity_id AS BIGINT)", "disposition": "disposition",
    "disposition_id": "CAST(disposition_id AS BIGINT)", "action_id": "CAST(action_id AS BIGINT)", "src_ip": "e_src",
    "src_port": "CAST(e_sport AS BIGINT)", "dst_ip": "e_dst", "dst_port": "CAST(e_dport AS BIGINT)",
    "protocol_name": "e_proto", "protocol_num": "CAST(e_num AS BIGINT)", "direction": "e_dir",
    "time_ms": "CAST(time_ms AS BIGINT)", "bytes_out": "CAST(e_out AS BIGINT)", "bytes_in": "CAST(e_in AS BIGINT)",
    "source_id": "sid", "vendor": "vendor",
}


def event_sql(where: str, *names: str) -> str:
    cols = ", ".join(f"{_ORACLE_COLS[n]} AS {n}" for n in names or _ORACLE_COLS)
    return f"{EVENT} SELECT eid, {cols} FROM f WHERE {where}"


# ---------------------------------------------------------------- ten device families
for _key, _ids, _fams, _where in [
    ("norm_pfsense", ("pfsense",), (0, 1), "sid = 'pfsense'"),
    ("norm_suricata", ("suricata",), (2,), "sid = 'suricata'"),
    ("norm_suricata_eve", ("suricata_eve",), (3,), "sid = 'suricata_eve'"),
    ("norm_squid", ("squid",), (4,), "sid = 'squid'"),
    ("norm_cisco_asa", ("cisco_asa",), (5,), "sid = 'cisco_asa'"),
    ("norm_fortigate", ("fortigate",), (6,), "sid = 'fortigate'"),
    ("norm_paloalto", ("paloalto",), (7,), "sid = 'paloalto'"),
    ("norm_leef", ("generic_leef",), (9,), "sid = 'generic_leef'"),
]:
    QUERIES[_key] = (lambda ids, fams: lambda spark, sf: pick(flat(spark, sf, reg(*ids), *fams)))(_ids, _fams)
    ORACLES[_key] = event_sql(_where)
for _key, _sid in [("norm_cef", "generic_cef"), ("norm_cef_base", "generic_cef_base")]:
    QUERIES[_key] = (lambda sid: lambda spark, sf: pick(flat(
        spark, sf, reg("generic_cef", "generic_cef_base"), 8)).filter(F.col("source_id") == sid))(_sid)
    ORACLES[_key] = event_sql(f"sid = '{_sid}'")


# ---------------------------------------------------------------- sources
@query("src_lines", BASE + "SELECT eid, 'file:squid' AS channel, strlen(line) AS size_bytes, sha256(line) AS sha256 FROM ("
       "SELECT eid, '###UNKNOWN### code=' || user_id || ' x~~y' AS line FROM d)")
def src_lines(spark, sf):
    """File bodies with padding and blank lines -> clean events."""
    bodies = fx.base(spark, sf).selectExpr("eid", "concat('\n  ###UNKNOWN### code=', user_id, ' x~~y \t\n\n') AS value")
    df = ingest.split_lines(bodies, "value", "file:squid")
    return df.selectExpr("eid", "channel", "CAST(octet_length(line) AS BIGINT) AS size_bytes", "sha2(line, 256) AS sha256")


@query("src_batch_json", BASE + "SELECT channel, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS rejected, "
       "CAST(sum(CASE WHEN k % 3 = 2 THEN 0 ELSE strlen(txt) END) AS BIGINT) AS bytes FROM (SELECT k, family, "
       "CASE WHEN k % 2 = 0 THEN 'http' ELSE 'udp:5514' END AS channel, 'code=' || user_id || ' \"q\" é' AS txt FROM d) GROUP BY channel")
def src_batch_json(spark, sf):
    """Batch bodies, one per user; every third event lacks ``raw``."""
    ev = fx.base(spark, sf).selectExpr(
        "user_id", "to_json(named_struct('raw', CASE WHEN k % 3 <> 2 THEN concat('code=', user_id, ' \"q\" é') END,"
                   " 'channel', CASE WHEN k % 2 = 1 THEN 'udp:5514' END)) AS item")
    bodies = ev.groupBy(F.expr("user_id"), F.expr("spark_partition_id()").alias("part")).agg(
        F.concat(F.lit('{"events": ['), F.concat_ws(", ", F.collect_list("item")), F.lit("]}")).alias("body"))
    rows = ingest.explode_batches(bodies, "body")
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.count("error").alias("rejected"),
                                       F.sum(F.when(F.col("error").isNull(), F.octet_length("raw"))).cast("bigint").alias("bytes"))


@query("src_deframe", BASE + "SELECT user_id, CAST(count(*) AS BIGINT) AS messages, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM ("
       "SELECT user_id, '###UNKNOWN### code=' || user_id || ' x~~y' AS line FROM d) GROUP BY user_id")
def src_deframe(spark, sf):
    """Captured streams, a whole one for each user in the order of its events: octet-counted and newline frames mixed in
    one blob, which ends without the last line's break."""
    msgs = fx.base(spark, sf).selectExpr(
        "user_id", "eid", "k", "concat('###UNKNOWN### code=', user_id, ' x~~y') AS line")
    framed = msgs.selectExpr("user_id", "eid", "CASE WHEN k % 2 = 0 THEN concat(octet_length(line), ' ', line)"
                                               " ELSE concat(line, '\r\n') END AS piece")
    blobs = framed.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("eid", "piece"))).alias("pieces")).select(
        "user_id", F.expr("CAST(rtrim('\r\n', concat_ws('', pieces.piece)) AS BINARY)").alias("content"))
    out = ingest.deframe_syslog(blobs, "content", ("user_id",))
    return out.groupBy("user_id").agg(F.count("*").alias("messages"),
                                      F.sum(F.octet_length("raw")).cast("bigint").alias("bytes"))


@query("src_datagram", BASE + "SELECT eid, sha256(line) AS sha256, CAST(strlen(line) AS BIGINT) AS size_bytes FROM ("
       "SELECT eid, 'code=' || user_id || ' x' AS line FROM d)")
def src_datagram(spark, sf):
    df = fx.base(spark, sf).selectExpr(
        "eid", "concat(CAST(concat('code=', user_id, ' x') AS BINARY), CASE k % 3 WHEN 0 THEN X'0D0A' WHEN 1 THEN X'00'"
               " ELSE X'' END) AS packet")
    return ingest.read_datagrams(df).selectExpr("eid", "sha2(raw, 256) AS sha256",
                                                "CAST(octet_length(raw) AS BIGINT) AS size_bytes")


@query("src_mint_ids", BASE + "SELECT eid, sha256(line) AS sha256, CAST(strlen(line) AS BIGINT) AS size_bytes, "
       "substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) AS event_id, "
       "'local://5514/' || substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) AS raw_ref "
       "FROM (SELECT eid, line, sha256('udp:5514|' || eid || '|' || sha256(line)) AS h FROM (SELECT eid, bsd || "
       "' fw01 filterlog: rule 12 ' || CASE WHEN blocked THEN 'block' ELSE 'pass' END || ' in on em0 src=' || src || ' dst=' || dst || ' proto=' || proto AS line "
       "FROM d))")
def src_mint_ids(spark, sf):
    rows = fx.base(spark, sf).selectExpr(
        "eid", "'udp:5514' AS channel", "CAST(concat(bsd, ' fw01 filterlog: rule 12 ', if(blocked, 'block', 'pass'), ' in on em0 src=', src, ' dst=', dst,"
        " ' proto=', proto) AS BINARY) AS raw")
    return ingest.mint_ids(rows, "eid").select("eid", "sha256", "size_bytes", "event_id", "raw_ref")


@query("src_decode", "SELECT doc_id, sha256(text || chr(65533) || 'z') AS sha256, CAST(length(text) + 2 AS BIGINT) AS n FROM documents")
def src_decode(spark, sf):
    """Whole texts with one invalid byte appended."""
    df = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "concat(CAST(text AS BINARY), X'FF', X'7A') AS raw")
    return pl.decode_utf8(df).selectExpr("doc_id", "sha2(text, 256) AS sha256", "CAST(length(text) AS BIGINT) AS n")


# ---------------------------------------------------------------- fingerprints and routing
@query("fp_contains", BASE + "SELECT eid FROM d WHERE family IN (0,1) OR (family = 10 AND k % 4 = 3) OR (family = 11 AND k % 2 = 1)")
def fp_contains(spark, sf):
    return fx.lines(spark, sf).filter(fp.fp_contains("filterlog")).select("eid")


@query("fp_startswith", BASE + "SELECT eid FROM d WHERE family IN (0,7) OR family = 9 OR (family = 10 AND k % 4 IN (0,1,3)) OR family IN (5,6)")
def fp_startswith(spark, sf):
    df = fx.lines(spark, sf).withColumn("text", F.concat(F.lit("\t "), "text"))
    return df.filter(fp.fp_any([{"type": "startswith", "pattern": "<"}, {"type": "startswith", "pattern": "LEEF:"}])).select("eid")


@query("fp_regex", BASE + "SELECT eid, family = 5 AS asa, family = 4 AS squid FROM d WHERE family IN (4,5)")
def fp_regex(spark, sf):
    r = reg()
    df = fx.lines(spark, sf).select("eid", fp.matches(r.get("cisco_asa")["fingerprint"]).alias("asa"),
                                    fp.matches(r.get("squid")["fingerprint"]).alias("squid"))
    return df.filter("asa OR squid")


@query("fp_json_key", BASE + "SELECT eid, family = 2 AS alert, TRUE AS typed FROM d WHERE family IN (2,3)")
def fp_json_key(spark, sf):
    df = fx.lines(spark, sf).select("eid", fp.fp_json_key("event_type", "alert").alias("alert"),
                                    fp.fp_json_key("event_type").alias("typed"))
    return df.filter("typed")


@query("fp_tree", BASE + "SELECT eid FROM d WHERE (family = 2 AND k % 4 = 1) OR family = 8")
def fp_tree(spark, sf):
    alert3 = {"type": "all", "rules": [{"type": "json_key", "key": "alert.severity", "value": 2},
                                       {"type": "json_key", "key": "src_ip"}]}
    return fx.lines(spark, sf).filter(fp.fp_any([alert3, {"type": "regex", "pattern": r"CEF:\d+\|"}])).select("eid")


@query("route_candidates", BASE + "SELECT eid, CASE family WHEN 2 THEN 'suricata,suricata_eve' WHEN 8 THEN 'generic_cef,generic_cef_base' "
       "WHEN 10 THEN CASE WHEN k % 4 = 3 THEN 'pfsense' ELSE '' END WHEN 11 THEN CASE WHEN k % 2 = 1 THEN 'pfsense' ELSE '' END ELSE sid END AS candidates FROM d")
def route_candidates(spark, sf):
    return pl.candidates(fx.lines(spark, sf), reg()).selectExpr("eid", "array_join(candidates, ',') AS candidates")


@query("route_winner", BASE + "SELECT eid, sid AS source_id, reason, CASE WHEN reason = 'tokenize_failed' THEN 'pfsense' END AS parser_id FROM d")
def route_winner(spark, sf):
    return pl.route(fx.raw_events(spark, sf), reg()).select("eid", "source_id", "reason", "parser_id")


@query("route_counts", BASE + "SELECT sid AS source_id, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY sid")
def route_counts(spark, sf):
    return pl.route(fx.raw_events(spark, sf), reg()).groupBy("source_id").agg(F.count("*").alias("n"))


@query("route_dlq_reasons", BASE + "SELECT reason, CASE WHEN reason = 'tokenize_failed' THEN 'no tokenize pattern matched' ELSE 'no fingerprint matched' END AS detail, "
       "CAST(count(*) AS BIGINT) AS n FROM d WHERE reason IS NOT NULL GROUP BY 1, 2")
def route_dlq_reasons(spark, sf):
    df = pl.route(fx.raw_events(spark, sf), reg()).filter("reason IS NOT NULL")
    return df.groupBy("reason", "detail").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- envelopes
def _env(df: DataFrame, *cols: str) -> DataFrame:
    return envelope.add_envelope(df).selectExpr("eid", *cols)


@query("env_5424", BASE + "SELECT eid, 'rfc5424' AS format, CAST(165 AS BIGINT) AS pri, 'h' || user_id AS host, 'app' AS app, "
       "CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END AS procid, CASE WHEN k % 3 = 0 THEN '[ex@1 u=\"' || user_id || '\"]' END AS sd, "
       "CAST(epoch_us(ts) AS BIGINT) AS time_us, 'hello ' || eid AS payload FROM d")
def env_5424(spark, sf):
    df = fx.base(spark, sf).selectExpr(
        "eid", "ingest_time", "concat('<165>1 ', iso, 'Z h', user_id, ' app ', if(k % 2 = 0, CAST(k AS STRING), '-'), ' - ',"
        " if(k % 3 = 0, concat('[ex@1 u=\"', user_id, '\"]'), '-'), ' hello ', eid) AS text")
    return _env(df, "env_format AS format", "CAST(env_pri AS BIGINT) AS pri", "env_hostname AS host", "env_app_name AS app",
                "env_procid AS procid", "env_structured_data AS sd", "env_time_us AS time_us", "payload")


@query("env_3164", BASE + "SELECT eid, 'rfc3164' AS format, CASE WHEN k % 2 = 0 THEN CAST(13 AS BIGINT) END AS pri, 'h' || user_id AS host, "
       "CASE WHEN k % 3 < 2 THEN 'sshd' END AS app, CASE WHEN k % 3 = 0 THEN '42' END AS procid, CAST(secs * 1000000 AS BIGINT) AS time_us, "
       "'msg ' || eid AS payload FROM d")
def env_3164(spark, sf):
    df = fx.base(spark, sf).selectExpr(
        "eid", "ingest_time", "concat(if(k % 2 = 0, '<13>', ''), if(k % 5 = 0, bsd_year, concat(left(bsd, 4),"
        " regexp_replace(substr(bsd, 5, 2), '^0', ' '), substr(bsd, 7))), ' h', user_id,"
        " CASE k % 3 WHEN 0 THEN ' sshd[42]: ' WHEN 1 THEN ' sshd: ' ELSE ' : ' END, 'msg ', eid) AS text")
    return _env(df, "env_format AS format", "CAST(env_pri AS BIGINT) AS pri", "env_hostname AS host", "env_app_name AS app",
                "env_procid AS procid", "env_time_us AS time_us", "payload")


@query("env_pri_only", BASE + "SELECT eid, CASE WHEN k % 2 = 0 THEN 'pri_only' END AS format, CASE WHEN k % 2 = 0 THEN CAST(user_id % 192 AS BIGINT) END AS pri, "
       "'code ' || eid AS payload FROM d")
def env_pri_only(spark, sf):
    df = fx.base(spark, sf).selectExpr(
        "eid", "ingest_time", "concat(if(k % 2 = 0, concat('<', user_id % 192, '>'), '  '), 'code ', eid) AS text")
    return _env(df, "env_format AS format", "CAST(env_pri AS BIGINT) AS pri", "payload")


@query("env_pri_stats", BASE + "SELECT CAST((user_id % 192) // 8 AS BIGINT) AS facility, CAST(user_id % 8 AS BIGINT) AS severity, "
       "CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1, 2")
def env_pri_stats(spark, sf):
    df = fx.base(spark, sf).selectExpr("eid", "ingest_time", "concat('<', user_id % 192, '>code ', eid) AS text")
    return envelope.add_envelope(df).groupBy(
        F.col("env_facility").cast("bigint").alias("facility"), F.col("env_syslog_severity").cast("bigint").alias("severity")
    ).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- tokenizers
def _payload(spark, sf, *families) -> DataFrame:
    return envelope.add_envelope(fx.lines(spark, sf, *families)).select("eid", "k", "text", "payload")


@query("tok_regex", "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\\d+)', 1) AS scheme, "
       "regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\\d+)', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\\d+)', 4) AS num "
       "FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/([a-z]+)/(\\d+)')")
def tok_regex(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("url").alias("payload"))
    out = tk.tokenize_regex(df, [r"^(?P<scheme>https?)://(?P<host>[^/]+)/(?P<lang>[a-z]+)/(?P<num>\d+)"])
    return out.filter("variant IS NOT NULL").selectExpr("page_id", "tokens['scheme'] AS scheme", "tokens['host'] AS host",
                                                        "tokens['num'] AS num")


@query("tok_regex_variants", BASE + "SELECT eid, CAST(CASE WHEN blocked THEN 0 ELSE 2 END AS BIGINT) AS variant, CASE WHEN blocked THEN '106023' ELSE '302013' END AS msg_id, "
       "src, CAST(sport AS VARCHAR) AS sport, CASE WHEN blocked THEN 'acl1' END AS acl, CASE WHEN NOT blocked THEN CAST(eid AS VARCHAR) END AS conn_id FROM d WHERE family = 5")
def tok_regex_variants(spark, sf):
    pats = reg().get("cisco_asa")["tokenize"]["patterns"]
    out = tk.tokenize_regex(_payload(spark, sf, 5), pats)
    return out.selectExpr("eid", "CAST(variant AS BIGINT) AS variant", *[f"tokens['{n}'] AS {n}" for n in
                                                                         ("msg_id", "src", "sport", "acl", "conn_id")])


@query("tok_json", BASE + "SELECT eid, src AS src_ip, CAST(dport AS VARCHAR) AS dest_port, CAST(k % 4 + 1 AS VARCHAR) AS severity, "
       "'Cat ' || (user_id % 5) AS category, CAST(13 AS BIGINT) AS n FROM d WHERE family = 2")
def tok_json(spark, sf):
    out = tk.tokenize_json(_payload(spark, sf, 2))
    return out.selectExpr("eid", "tokens['src_ip'] AS src_ip", "tokens['dest_port'] AS dest_port",
                          "tokens['alert.severity'] AS severity", "tokens['alert.category'] AS category",
                          "CAST(size(tokens) AS BIGINT) AS n")


@query("tok_json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def tok_json_props(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "props AS payload")
    return tk.tokenize_json(df).selectExpr("event_id", "tokens['k'] AS k")


@query("tok_kv", BASE + "SELECT eid, src AS srcip, CAST(dport AS VARCHAR) AS dstport, 'k' || user_id AS custom, 'FGT' AS devname, "
       "'say \"hi\" x' AS note, 'last' AS dup FROM d WHERE family = 6")
def tok_kv(spark, sf):
    df = _payload(spark, sf, 6).selectExpr("eid", "concat(payload, ' note=\"say \\\\\"hi\\\\\" x\" dup=first dup=last') AS payload")
    out = tk.tokenize_kv(df)
    return out.selectExpr("eid", *[f"tokens['{n}'] AS {n}" for n in ("srcip", "dstport", "custom", "devname", "note", "dup")])


@query("tok_csv", BASE + "SELECT eid, CAST(eid AS VARCHAR) AS a, CASE WHEN k % 2 = 0 THEN 'x,\"' || user_id || '\"' ELSE 'plain' END AS c, "
       "CASE WHEN k % 3 <> 0 THEN 'd' || k END AS d, 'extra' AS col5 FROM d")
def tok_csv(spark, sf):
    df = fx.base(spark, sf).selectExpr(
        "eid", "concat(eid, ',skip,', if(k % 2 = 0, concat('\"x,\"\"', user_id, '\"\"\"'), 'plain'), ',', if(k % 3 <> 0, concat('d', k), ''),"
               " ',e,extra') AS payload")
    out = tk.tokenize_csv(df, ["a", "_", "c", "d", None])
    return out.selectExpr("eid", "tokens['a'] AS a", "tokens['c'] AS c", "tokens['d'] AS d", "tokens['_col5'] AS col5")


@query("tok_cef", BASE + "SELECT eid, 'Ven|dor' AS vendor, CAST(k % 11 AS VARCHAR) AS severity, CASE WHEN k % 5 <> 0 THEN src END AS src, "
       "CAST(ms AS VARCHAR) AS rt, 'a=b c' AS msg FROM d WHERE family = 8")
def tok_cef(spark, sf):
    out = tk.tokenize_cef(_payload(spark, sf, 8))
    return out.selectExpr("eid", "tokens['device_vendor'] AS vendor", "tokens['severity'] AS severity", "tokens['src'] AS src",
                          "tokens['rt'] AS rt", "tokens['msg'] AS msg")


@query("tok_leef", BASE + "SELECT eid, CASE WHEN k % 3 = 0 THEN '2.0' ELSE '1.0' END AS version, 'V' AS vendor, src, CAST(dport AS VARCHAR) AS dst_port, "
       "CASE WHEN k % 3 = 2 THEN NULL ELSE 'EVT' END AS event_id FROM d WHERE family = 9")
def tok_leef(spark, sf):
    """Version 2 with ^, version 1 with tabs, and version 1 with spaces and no final bar."""
    df = fx.base(spark, sf).filter("family = 9").selectExpr(
        "eid", "CASE k % 3 WHEN 0 THEN concat('LEEF:2.0|V|P|1|EVT|^|src=', src, '^dstPort=', dport)"
               " WHEN 1 THEN concat('LEEF:1.0|V|P|1|EVT\tsrc=', src, '\tdstPort=', dport)"
               " ELSE concat('LEEF:1.0|V|P|1||src=', src, ' dstPort=', dport) END AS payload")
    out = tk.tokenize_leef(df)
    return out.selectExpr("eid", "tokens['leef_version'] AS version", "tokens['device_vendor'] AS vendor", "tokens['src'] AS src",
                          "tokens['dstPort'] AS dst_port", "nullif(tokens['event_id'], '') AS event_id")


@query("tok_xml", BASE + "SELECT eid, CAST(4600 + k % 100 AS VARCHAR) AS event_code, src AS ip, CAST(user_id AS VARCHAR) AS lvl, CAST(4 AS BIGINT) AS n FROM d")
def tok_xml(spark, sf):
    df = fx.base(spark, sf).selectExpr(
        "eid", "concat('<Event xmlns=\"urn:e\"><System><EventID level=\"', user_id, '\">', 4600 + k % 100,"
               " '</EventID></System><EventData><Data Name=\"IpAddress\">', src, '</Data><Data Name=\"Empty\"/><x>v</x></EventData></Event>') AS payload")
    out = tk.tokenize_xml(df)
    return out.selectExpr("eid", "tokens['Event.System.EventID'] AS event_code", "tokens['IpAddress'] AS ip",
                          "tokens['Event.System.EventID@level'] AS lvl", "CAST(size(tokens) AS BIGINT) AS n")


@query("tok_dispatch", BASE + "SELECT eid, CASE family WHEN 2 THEN 'json' WHEN 3 THEN 'json' WHEN 6 THEN 'kv' WHEN 7 THEN 'csv' WHEN 8 THEN 'cef' WHEN 9 THEN 'leef' "
       "ELSE 'regex' END AS format, CASE WHEN family = 8 AND k % 5 = 0 THEN NULL ELSE src END AS src FROM d WHERE family <= 9")
def tok_dispatch(spark, sf):
    r = reg()
    out = pl.tokenize(fx.raw_events(spark, sf), r)
    kinds = {p["source_id"]: p["tokenize"]["type"] for p in r.parsers}
    fmt = "CASE " + " ".join(f"WHEN parser = '{s}' THEN '{t}'" for s, t in kinds.items()) + " END"
    return out.filter("tokens IS NOT NULL").selectExpr(
        "eid", f"{fmt} AS format", "coalesce(tokens['src'], tokens['srcip'], tokens['src_ip']) AS src")


@query("tok_flatten", BASE + "SELECT eid, CAST(user_id AS VARCHAR) AS deep, CASE WHEN k % 2 = 0 THEN 'flat' ELSE 'nested' END AS ab, '[1,2]' AS arr, "
       "'{}' AS empty, CAST(5 AS BIGINT) AS n FROM d")
def tok_flatten(spark, sf):
    """A flat key with a dot beats the nested path; lists stay whole."""
    df = fx.base(spark, sf).selectExpr(
        "eid", "concat('{\"p\":{\"q\":{\"r\":{\"s\":', user_id, '}}},\"a\":{\"b\":\"nested\"},', if(k % 2 = 0, '\"a.b\":\"flat\",', ''),"
               " '\"l\":[1,2],\"o\":{},\"z\":null}') AS payload")
    return tk.tokenize_json(df).selectExpr("eid", "tokens['p.q.r.s'] AS deep", "tokens['a.b'] AS ab", "tokens['l'] AS arr",
                                           "tokens['o'] AS empty", "CAST(size(tokens) AS BIGINT) AS n")


# ---------------------------------------------------------------- normalization, step by step
@query("norm_static", BASE + "SELECT eid, CASE WHEN blocked THEN 'Refuse' ELSE 'Open' END AS activity_name, CASE WHEN src_int AND dst_int THEN 'Lateral' ELSE 'Lateral' END AS direction, "
       "'Allowed' AS disposition FROM d WHERE family = 5")
def norm_static(spark, sf):
    """Constants of the definition first, constants of the matched pattern last."""
    p = dict(reg().get("cisco_asa"))
    m = {k: v for k, v in p["mapping"].items() if k != "lookups"}
    p["mapping"] = m
    p["ocsf"] = {**p["ocsf"], "static": {"connection_info.direction": "Lateral", "disposition": "Allowed"}}
    out = flat(spark, sf, Registry.of([p]), 5)
    return pick(out, "activity_name", "direction", "disposition")


_EXTRACT = {
    "source_id": "swall", "fingerprint": {"type": "contains", "pattern": "id=firewall"}, "tokenize": {"type": "kv"},
    "ocsf": {"class_uid": 4001, "activity": "Traffic"},
    "mapping": {
        "extract": [{"from": "src", "pattern": r"^(?P<s_ip>[\d.]+):(?P<s_port>\d+)"},
                    {"from": "dst", "pattern": r"^(?P<d_ip>[\d.]+):(?P<d_port>\d+)"}],
        "fields": {"s_ip": "src_endpoint.ip", "s_port": "src_endpoint.port", "d_ip": "dst_endpoint.ip",
                   "d_port": "dst_endpoint.port", "msg": "message"},
        "timestamp": {"source": "time", "format": "%Y-%m-%d %H:%M:%S UTC"}},
}


@query("norm_extract", BASE + "SELECT eid, src AS src_ip, CAST(sport AS BIGINT) AS src_port, dst AS dst_ip, CAST(dport AS BIGINT) AS dst_port, "
       "CAST(secs * 1000 AS BIGINT) AS time_ms, FALSE AS src_kept FROM d WHERE family = 10 AND k % 4 = 0")
def norm_extract(spark, sf):
    out = flat(spark, sf, Registry.of([_EXTRACT]), 10).filter("reason IS NULL")
    return out.selectExpr("eid", "src_endpoint__ip AS src_ip", "CAST(src_endpoint__port AS BIGINT) AS src_port",
                          "dst_endpoint__ip AS dst_ip", "CAST(dst_endpoint__port AS BIGINT) AS dst_port", "time AS time_ms",
                          "map_contains_key(unmapped, 'src') AS src_kept")


@query("norm_fields", BASE + "SELECT eid, 'FGT' AS device, CAST(bytes_out AS BIGINT) AS bytes_out, src AS src_ip, src AS src_host, CASE WHEN k % 2 = 0 THEN NULL ELSE 'x' END AS rule FROM d WHERE family = 6")
def norm_fields(spark, sf):
    """One token to several paths; '-' and empty are skipped; the later mapping wins."""
    p = dict(reg().get("fortigate"))
    fields = {"early": "firewall_rule.name", **p["mapping"]["fields"], "srcip": ["src_endpoint.ip", "src_endpoint.hostname"],
              "late": "firewall_rule.name"}
    p["mapping"] = {**p["mapping"], "fields": fields}
    raw = fx.raw_events(spark, sf, 6).withColumn("text", F.expr("concat(text, if(k % 2 = 0, ' early=- late=\"\"', ' early=y late=x'))"))
    out = pl.parse_flat(raw, Registry.of([p])).filter("reason IS NULL")
    return out.selectExpr("eid", "device__hostname AS device", "traffic__bytes_out AS bytes_out", "src_endpoint__ip AS src_ip",
                          "src_endpoint__hostname AS src_host", "firewall_rule__name AS rule")


@query("norm_values", BASE + "SELECT eid, CASE k % 3 WHEN 0 THEN 'Blocked' WHEN 1 THEN 'Allowed' ELSE 'weird' END AS disposition FROM d WHERE family = 6")
def norm_values(spark, sf):
    """Case-insensitive; a value without an entry is kept."""
    raw = fx.raw_events(spark, sf, 6).withColumn("text", F.expr(
        "regexp_replace(text, 'action=\"[a-z]+\"', concat('action=\"', element_at(array('DENY', 'Accept', 'weird'), CAST(k % 3 + 1 AS INT)), '\"'))"))
    return pick(pl.parse_flat(raw, reg("fortigate")), "disposition")


@query("norm_lookup", event_sql("family IN (0,1)", "activity_name", "severity_id"))
def norm_lookup(spark, sf):
    return pick(flat(spark, sf, reg("pfsense"), 0, 1), "activity_name", "severity_id")


@query("norm_types", BASE + "SELECT eid, CASE WHEN k % 2 = 0 THEN bytes_out END AS bytes_out, CASE WHEN k % 2 = 1 THEN 'n/a' || k END AS extra FROM d WHERE family = 6")
def norm_types(spark, sf):
    raw = fx.raw_events(spark, sf, 6).withColumn("text", F.expr(
        "CASE WHEN k % 2 = 1 THEN regexp_replace(text, 'sentbyte=[0-9]+', concat('sentbyte=n/a', k)) ELSE text END"))
    out = pl.parse_flat(raw, reg("fortigate")).filter("reason IS NULL")
    return out.selectExpr("eid", "traffic__bytes_out AS bytes_out", "extra['traffic.bytes_out'] AS extra")


@query("norm_class", EVENT + "SELECT eid, CAST(class_uid AS BIGINT) AS class_uid, class_name, CAST(activity_id AS BIGINT) AS activity_id, "
       "CAST(class_uid * 100 + activity_id AS BIGINT) AS type_uid, class_name || ': ' || activity_name AS type_name FROM f WHERE family IN (2,4,8)")
def norm_class(spark, sf):
    out = flat(spark, sf, reg("suricata", "squid", "generic_cef", "generic_cef_base"), 2, 4, 8).filter("reason IS NULL")
    return out.selectExpr("eid", "CAST(class_uid AS BIGINT) AS class_uid", "class_name", "CAST(activity_id AS BIGINT) AS activity_id",
                          "CAST(type_uid AS BIGINT) AS type_uid", "type_name")


@query("norm_severity", BASE + "SELECT eid, CAST(CASE k % 6 WHEN 0 THEN 6 WHEN 1 THEN 99 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 4 ELSE 0 END AS BIGINT) AS severity_id, "
       "CASE k % 6 WHEN 0 THEN 'Fatal' WHEN 1 THEN 'Other' WHEN 2 THEN 'Informational' WHEN 3 THEN 'Informational' WHEN 4 THEN 'High' ELSE 'Unknown' END AS severity FROM d WHERE family = 6")
def norm_severity(spark, sf):
    raw = fx.raw_events(spark, sf, 6).withColumn("text", F.expr(
        "regexp_replace(text, 'level=\"[a-z]+\"', concat('level=\"', element_at(array('Emergency', '42', 'odd', 'notice', '4', '0'), CAST(k % 6 + 1 AS INT)), '\"'))"))
    out = pl.parse_flat(raw, reg("fortigate")).filter("reason IS NULL")
    return out.selectExpr("eid", "CAST(severity_id AS BIGINT) AS severity_id", "severity")


@query("norm_disposition", EVENT + "SELECT eid, disposition, CAST(disposition_id AS BIGINT) AS disposition_id, action, CAST(action_id AS BIGINT) AS action_id FROM f WHERE family IN (2,9)")
def norm_disposition(spark, sf):
    out = flat(spark, sf, reg("suricata", "generic_leef"), 2, 9).filter("reason IS NULL")
    return out.selectExpr("eid", "disposition", "CAST(disposition_id AS BIGINT) AS disposition_id", "action",
                          "CAST(action_id AS BIGINT) AS action_id")


@query("norm_protocol", BASE + "SELECT eid, CASE k % 4 WHEN 0 THEN 'udp' WHEN 1 THEN 'icmp' WHEN 2 THEN '200' ELSE 'weird' END AS protocol_name, "
       "CAST(CASE k % 4 WHEN 0 THEN 17 WHEN 1 THEN 1 WHEN 2 THEN 200 END AS BIGINT) AS protocol_num FROM d WHERE family = 9")
def norm_protocol(spark, sf):
    raw = fx.raw_events(spark, sf, 9).withColumn("text", F.expr(
        "regexp_replace(text, 'proto=[0-9]+', concat('proto=', element_at(array('17', 'ICMP', '200', 'Weird'), CAST(k % 4 + 1 AS INT))))"))
    return pick(pl.parse_flat(raw, reg("generic_leef")), "protocol_name", "protocol_num")


@query("norm_ports", BASE + "SELECT eid, CAST(CASE k % 3 WHEN 0 THEN sport WHEN 1 THEN 12 END AS BIGINT) AS src_port, CAST(dport AS BIGINT) AS dst_port FROM d WHERE family = 9")
def norm_ports(spark, sf):
    raw = fx.raw_events(spark, sf, 9).withColumn("text", F.expr(
        "CASE k % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, 'srcPort=[0-9]+', 'srcPort= 12 ')"
        " ELSE regexp_replace(text, 'srcPort=[0-9]+', 'srcPort=12.5') END"))
    return pick(pl.parse_flat(raw, reg("generic_leef")), "src_port", "dst_port")


_FORMATS = [("epoch", "concat(secs, '.', lpad(CAST(ms % 1000 AS STRING), 3, '0'))"), ("epoch_ms", "CAST(ms AS STRING)"),
            ("epoch_ns", "concat(ms, '000000')"), ("iso8601", "concat(iso, '+0000')"), ("%Y-%m-%d %H:%M:%S", "concat(day, '  ', clock)"),
            ("%d/%b/%Y:%H:%M:%S %z", "date_format(ts + INTERVAL 2 HOURS, 'dd/MMM/yyyy:HH:mm:ss +0200')"),
            ("%m/%d/%Y %H:%M:%S", "date_format(ts, 'MM/dd/yyyy HH:mm:ss')"), ("syslog", "bsd_year")]


@query("time_formats", BASE + "SELECT eid, CAST(CASE WHEN eid % 8 < 4 THEN ms ELSE secs * 1000 END AS BIGINT) AS ms, CAST(secs * 1000 - 19800000 AS BIGINT) AS offset_ms FROM d")
def time_formats(spark, sf):
    """Every format, plus one configured zone offset (+05:30)."""
    text = "CASE eid % 8 " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(_FORMATS)) + " END"
    df = fx.base(spark, sf).selectExpr("eid", f"{text} AS t", "concat(day, ' ', clock) AS plain", "unix_micros(ingest_time) AS now")
    us = "CASE eid % 8 " + " ".join(f"WHEN {i} THEN {tp.value_us('t', f, 'now')}" for i, (f, _) in enumerate(_FORMATS)) + " END"
    shifted = tp.value_us("plain", "%Y-%m-%d %H:%M:%S", "now", tp.zone_offset_micros("+05:30"))
    return df.selectExpr("eid", f"{tp.millis('(' + us + ')')} AS ms", f"{tp.millis('(' + shifted + ')')} AS offset_ms")


@query("time_fallback", BASE + "SELECT eid, CAST(CASE k % 3 WHEN 0 THEN secs * 1000 WHEN 1 THEN secs * 1000 ELSE ms + 1000 END AS BIGINT) AS time_ms, "
       "CASE WHEN k % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'never 00:00' END AS original FROM d WHERE family = 6")
def time_fallback(spark, sf):
    """Payload time, else the header's, else ingest; the original text is kept."""
    raw = fx.raw_events(spark, sf, 6).withColumn("text", F.expr(
        "CASE k % 3 WHEN 0 THEN text ELSE concat(if(k % 3 = 1, concat('<189>', date_format(ts, 'MMM dd HH:mm:ss'), ' h '), '<189>'),"
        " regexp_replace(substr(text, 6), '^date=\\\\S+ time=\\\\S+', 'date=never time=00:00')) END"))
    out = pl.parse_flat(raw, reg("fortigate")).filter("reason IS NULL")
    return out.selectExpr("eid", "time AS time_ms", "metadata__original_time AS original")


@query("time_bsd_year", BASE + "SELECT eid, CAST(CASE WHEN k % 2 = 0 THEN secs ELSE epoch_us(ts::DATE + INTERVAL 3 DAY - INTERVAL 1 YEAR) // 1000000 END AS BIGINT) AS secs FROM d WHERE month(ts + INTERVAL 3 DAY) = month(ts)")
def time_bsd_year(spark, sf):
    """Header times without a year: this year, or last year when days ahead."""
    df = fx.base(spark, sf).filter("month(ts + INTERVAL 3 DAYS) = month(ts)").selectExpr(
        "eid", "CASE WHEN k % 2 = 0 THEN bsd ELSE concat(date_format(ts + INTERVAL 3 DAYS, 'MMM d'), ' 00:00:00') END AS t",
        "unix_micros(ingest_time) AS now")
    return df.selectExpr("eid", f"({tp.bsd_us('t', 'now')}) DIV 1000000 AS secs").selectExpr("eid", "CAST(secs AS BIGINT) AS secs")


@query("norm_unmapped", BASE + "SELECT eid, 'k' || user_id AS custom, 'F1' AS devid, CASE WHEN k % 2 = 0 THEN '-' END AS dash, CAST(CASE WHEN k % 2 = 0 THEN 5 ELSE 4 END AS BIGINT) AS n FROM d WHERE family = 6")
def norm_unmapped(spark, sf):
    raw = fx.raw_events(spark, sf, 6).withColumn("text", F.expr("CASE WHEN k % 2 = 0 THEN concat(text, ' app=-') ELSE text END"))
    out = pl.parse_flat(raw, reg("fortigate")).filter("reason IS NULL")
    return out.selectExpr("eid", "unmapped['custom'] AS custom", "unmapped['devid'] AS devid", "unmapped['app'] AS dash",
                          "CAST(size(unmapped) AS BIGINT) AS n")


@query("norm_metadata", BASE + "SELECT eid, sha256(line) AS raw_sha256, CAST(strlen(line) AS BIGINT) AS raw_size, 'pfsense' AS parser_id, 'v2' AS parser_version, 'filterlog' AS log_name, "
       "'Netgate' AS vendor, 'udp:5514' AS channel, bsd AS original_time, strftime(ts + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS ingest_time, '1.3.0' AS version "
       "FROM (SELECT *, bsd || ' fw01 filterlog: rule 12 ' || CASE WHEN blocked THEN 'block' ELSE 'pass' END || ' in on em0 src=' || src || ' dst=' || dst || ' proto=' || proto AS line FROM d WHERE family = 1)")
def norm_metadata(spark, sf):
    out = flat(spark, sf, reg("pfsense"), 1).filter("reason IS NULL")
    return out.selectExpr("eid", *[f"metadata__{a} AS {b}" for a, b in [
        ("raw_sha256", "raw_sha256"), ("raw_size", "raw_size"), ("parser__id", "parser_id"), ("parser__version", "parser_version"),
        ("log_name", "log_name"), ("product__vendor_name", "vendor"), ("ingest_channel", "channel"), ("original_time", "original_time"),
        ("ingest_time", "ingest_time"), ("version", "version")]])


@query("norm_device", BASE + "SELECT eid, CASE family WHEN 1 THEN 'fw01' WHEN 6 THEN 'FGT' WHEN 5 THEN 'asa' END AS hostname FROM d WHERE family IN (1,5,6,9)")
def norm_device(spark, sf):
    out = flat(spark, sf, reg("pfsense", "cisco_asa", "fortigate", "generic_leef"), 1, 5, 6, 9).filter("reason IS NULL")
    return out.selectExpr("eid", "device__hostname AS hostname")


# ---------------------------------------------------------------- enrichment
_IPS = ("CASE k % 6 WHEN 0 THEN src WHEN 1 THEN concat('172.', 15 + user_id % 4, '.', tail, '.1') WHEN 2 THEN concat('fd00::', hex(tail))"
        " WHEN 3 THEN concat('2001:db8::', hex(tail)) WHEN 4 THEN concat('300.1.1.', tail) ELSE '127.0.0.1' END")


@query("enrich_internal", BASE + "SELECT eid, CASE k % 6 WHEN 0 THEN src_int WHEN 1 THEN user_id % 4 >= 1 WHEN 2 THEN TRUE WHEN 3 THEN FALSE WHEN 4 THEN NULL ELSE TRUE END AS internal FROM d")
def enrich_internal(spark, sf):
    df = fx.base(spark, sf).selectExpr("eid", f"{_IPS} AS ip")
    return df.select("eid", enrich.ip_in_cidrs("ip").alias("internal"))


@query("join_cidr_range", BASE + ", nets AS (SELECT DISTINCT user_id % 256 AS o FROM d) SELECT eid, '10.' || o || '.0.0/16' AS cidr FROM d JOIN nets ON src LIKE '10.%' AND split_part(src, '.', 2) = CAST(o AS VARCHAR)")
def join_cidr_range(spark, sf):
    """Addresses against a network TABLE derived from the users."""
    df = fx.base(spark, sf)
    nets = df.selectExpr("concat('10.', user_id % 256, '.0.0/16') AS cidr").distinct()
    low = f"({ipf.ipv4_num('split(cidr, ' + repr('/') + ')[0]')})"
    nets = nets.selectExpr("cidr", f"{low} AS low4", f"{low} + 65535L AS high4", "CAST(NULL AS STRING) AS low6", "CAST(NULL AS STRING) AS high6")
    return enrich.join_cidrs(df.selectExpr("eid", "src"), "src", nets).select("eid", "cidr")


@query("join_cidr6", BASE + ", h AS (SELECT eid, user_id % 4096 AS h FROM d) SELECT eid, '2001:db8::/32' AS cidr FROM h UNION ALL "
       "SELECT eid, '2001:db8:' || printf('%x', h - h % 16) || '::/44' AS cidr FROM h UNION ALL SELECT eid, '2001:db8:' || printf('%x', h) || ':8000::/49' AS cidr FROM h WHERE eid % 2 = 1")
def join_cidr6(spark, sf):
    """IPv6 addresses, all of one /16, against nested networks derived from the users."""
    df = fx.base(spark, sf)
    site = "lower(hex(user_id % 4096))"
    nets = df.selectExpr(f"explode(array('2001:db8::/32', concat('2001:db8:', lower(hex(user_id % 4096 - user_id % 16)), '::/44'),"
                         f" concat('2001:db8:', {site}, ':8000::/49'))) AS cidr")
    rows = df.selectExpr("eid", f"concat('2001:db8:', {site}, CASE WHEN eid % 2 = 1 THEN ':8001::' ELSE ':7fff::' END, lower(hex(eid % 65536))) AS ip")
    return enrich.join_cidrs(rows, "ip", enrich.network_bounds(nets)).select("eid", "cidr")


def _enriched(spark, sf) -> DataFrame:
    return enrich.enrich_endpoints(fx.base(spark, sf).selectExpr("eid", "src AS src_ip", "dst AS dst_ip", "dport AS dst_port"))


@query("enrich_zone", BASE + "SELECT eid, CASE WHEN src_int THEN 'internal' ELSE 'external' END AS src_zone, CASE WHEN dst_int THEN 'internal' ELSE 'external' END AS dst_zone FROM d")
def enrich_zone(spark, sf):
    return _enriched(spark, sf).select("eid", "src_zone", "dst_zone")


@query("enrich_direction", BASE + "SELECT eid, dir AS direction, CAST(dir_id AS BIGINT) AS direction_id FROM d")
def enrich_direction(spark, sf):
    return _enriched(spark, sf).selectExpr("eid", "direction", "CAST(direction_id AS BIGINT) AS direction_id")


@query("enrich_service", BASE + "SELECT eid, svc AS svc_name FROM d")
def enrich_service(spark, sf):
    return _enriched(spark, sf).select("eid", "svc_name")


@query("enrich_port_class", BASE + "SELECT eid, CASE WHEN dport < 1024 THEN 'well_known' WHEN dport < 49152 THEN 'registered' ELSE 'dynamic' END AS dst_port_class, "
       "dport IN (21,3389,445) AS dst_port_risky FROM d")
def enrich_port_class(spark, sf):
    return _enriched(spark, sf).select("eid", "dst_port_class", "dst_port_risky")


@query("enrich_flags", EVENT + "SELECT eid, COALESCE(action_id = 2, FALSE) AS is_blocked, class_uid = 2004 AS is_finding, CAST(severity_id AS BIGINT) AS severity_score FROM f WHERE family IN (2,6)")
def enrich_flags(spark, sf):
    out = flat(spark, sf, reg("suricata", "fortigate"), 2, 6).filter("reason IS NULL")
    return out.selectExpr("eid", "enrichments__is_blocked AS is_blocked", "enrichments__is_finding AS is_finding",
                          "CAST(enrichments__severity_score AS BIGINT) AS severity_score")


# ---------------------------------------------------------------- validation
def corrupted(spark, sf) -> DataFrame:
    """Family 9 with values that break one rule each, by residue."""
    return fx.raw_events(spark, sf, 9).withColumn("text", F.expr(
        "CASE k % 5 WHEN 1 THEN regexp_replace(text, 'src=[^^]+', 'src=300.1.1.1') WHEN 2 THEN regexp_replace(text, 'dstPort=[0-9]+', 'dstPort=70000')"
        " WHEN 3 THEN regexp_replace(text, 'proto=[0-9]+', 'proto=999') WHEN 4 THEN regexp_replace(text, 'src=.*action', 'action') ELSE text END"))


_BROKEN = ("CASE k % 5 WHEN 1 THEN 'src_endpoint.ip: value ''300.1.1.1'' does not match the expected format' WHEN 2 THEN 'dst_endpoint.port: 70000 is greater than the maximum of 65535' "
           "WHEN 3 THEN 'connection_info.protocol_num: 999 is greater than the maximum of 255' WHEN 4 THEN '<root>: needs one of src_endpoint / dst_endpoint' END")


@query("validate_errors", BASE + f"SELECT eid, {_BROKEN} AS errors, CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n FROM d WHERE family = 9")
def validate_errors(spark, sf):
    ev = pl.to_events_with(pl.parse_flat(corrupted(spark, sf), reg("generic_leef"), enforce=False), "eid")
    return val.validate(ev).selectExpr("eid", "nullif(array_join(errors, '; '), '') AS errors", "CAST(size(errors) AS BIGINT) AS n")


@query("validate_counts", BASE + f"SELECT {_BROKEN} AS detail, CAST(count(*) AS BIGINT) AS n FROM d WHERE family = 9 AND k % 5 <> 0 GROUP BY 1")
def validate_counts(spark, sf):
    df = pl.route(corrupted(spark, sf), reg("generic_leef")).filter("reason = 'schema_violation'")
    return df.groupBy("detail").agg(F.count("*").alias("n"))


@query("validate_conditional", BASE + "SELECT eid, CASE k % 3 WHEN 0 THEN 'schema_violation' WHEN 1 THEN 'schema_violation' END AS reason, "
       "CASE k % 3 WHEN 0 THEN '<root>: ''http_request'' is a required property' WHEN 1 THEN '<root>: ''finding_info'' is a required property' END AS detail FROM d WHERE family = 11 AND k % 2 = 0")
def validate_conditional(spark, sf):
    """Class chosen by the data: 4002 and 2004 need their objects, 0 needs nothing."""
    p = {"source_id": "unk", "fingerprint": {"type": "startswith", "pattern": "###"}, "tokenize": {"type": "kv"},
         "mapping": {"fields": {"cls": "class_uid"}}}
    raw = fx.raw_events(spark, sf, 11).filter("k % 2 = 0").withColumn(
        "text", F.expr("concat(text, ' cls=', element_at(array('4002', '2004', '0'), CAST(k % 3 + 1 AS INT)))"))
    return pl.route(raw, Registry.of([p])).select("eid", "reason", "detail")


@query("validate_top_errors", BASE + f"SELECT error, n FROM (SELECT 'schema_violation: ' || {_BROKEN} AS error, CAST(count(*) AS BIGINT) AS n FROM d WHERE family = 9 AND k % 5 <> 0 GROUP BY 1) ORDER BY n DESC, error LIMIT 5")
def validate_top_errors(spark, sf):
    df = pl.route(corrupted(spark, sf), reg("generic_leef")).filter("reason IS NOT NULL")
    msgs = df.selectExpr("concat(reason, ': ', detail) AS error")
    return msgs.groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(5)
