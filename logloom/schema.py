"""Table schemas and the event taxonomy (an OCSF 1.3 subset)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import types as T

_ENDPOINT = ("STRUCT<ip: STRING, port: INT, hostname: STRING, interface_name: STRING,"
             " mac: STRING, zone: STRING, svc_name: STRING>")

EVENT_DDL = f"""
class_uid INT, class_name STRING, category_uid INT, category_name STRING, activity_id INT,
activity_name STRING, type_uid INT, type_name STRING, severity_id INT, severity STRING,
time BIGINT, time_dt STRING, message STRING, disposition STRING, disposition_id INT,
action STRING, action_id INT, duration BIGINT, app_name STRING,
src_endpoint {_ENDPOINT},
dst_endpoint {_ENDPOINT},
connection_info STRUCT<protocol_name: STRING, protocol_num: INT, direction: STRING,
  direction_id: INT, uid: STRING>,
traffic STRUCT<bytes: BIGINT, bytes_in: BIGINT, bytes_out: BIGINT, packets: BIGINT>,
firewall_rule STRUCT<name: STRING, uid: STRING>,
http_request STRUCT<http_method: STRING, url: STRUCT<url_string: STRING>>,
http_response STRUCT<code: INT, length: BIGINT, content_type: STRING>,
finding_info STRUCT<title: STRING, uid: STRING, `desc`: STRING>,
actor STRUCT<user: STRUCT<name: STRING>>,
device STRUCT<hostname: STRING, ip: STRING, uid: STRING>,
process STRUCT<cmd_line: STRING, file: STRUCT<path: STRING>, pid: STRING>,
metadata STRUCT<uid: STRING, version: STRING, event_code: STRING,
  product: STRUCT<name: STRING, vendor_name: STRING, version: STRING>, source_id: STRING,
  log_name: STRING, parser: STRUCT<id: STRING, version: STRING>, raw_sha256: STRING,
  raw_ref: STRING, raw_size: BIGINT, ingest_channel: STRING, ingest_time: STRING,
  schema_version: STRING, original_time: STRING,
  envelope: STRUCT<format: STRING, pri: INT, facility: INT, syslog_severity: INT,
    timestamp: STRING, hostname: STRING, app_name: STRING, procid: STRING, msgid: STRING,
    structured_data: STRING, time: STRING>>,
enrichments STRUCT<src_is_internal: BOOLEAN, dst_is_internal: BOOLEAN, dst_port_class: STRING,
  dst_port_risky: BOOLEAN, is_blocked: BOOLEAN, is_finding: BOOLEAN, severity_score: INT>,
unmapped MAP<STRING, STRING>, extra MAP<STRING, STRING>
"""

RAW_DDL = ("event_id STRING, raw BINARY, channel STRING, source_hint STRING, ingest_time TIMESTAMP,"
           " raw_ref STRING, sha256 STRING, size_bytes BIGINT")

DLQ_DDL = ("event_id STRING, channel STRING, source_hint STRING, raw_snippet STRING, error STRING,"
           " reason STRING, parser_id STRING, cluster_id STRING, cluster_label STRING, format_guess STRING,"
           " raw_ref STRING, raw_sha256 STRING, ingest_time TIMESTAMP, ts TIMESTAMP, status STRING")

PROPOSAL_DDL = ("id BIGINT, cluster_id STRING, channel STRING, cluster_label STRING, created_at TIMESTAMP,"
                " updated_at TIMESTAMP, filename STRING, yaml STRING, generator STRING, sample_count INT,"
                " pending_at_creation BIGINT, match_rate DOUBLE, validation STRING, awareness STRING,"
                " status STRING, note STRING")

# The event taxonomy.
CATEGORIES = {
    0: "Uncategorized", 1: "System Activity", 2: "Findings", 3: "Identity & Access Management",
    4: "Network Activity", 5: "Discovery", 6: "Application Activity",
}
CLASSES = {  # class_uid: (name, category_uid)
    0: ("Base Event", 0), 1007: ("Process Activity", 1), 2004: ("Detection Finding", 2),
    3002: ("Authentication", 3), 4001: ("Network Activity", 4), 4002: ("HTTP Activity", 4),
    4003: ("DNS Activity", 4),
}
ACTIVITIES = {
    0: {0: "Unknown", 99: "Other"},
    1007: {0: "Unknown", 1: "Launch", 2: "Terminate", 3: "Open", 4: "Inject", 99: "Other"},
    2004: {0: "Unknown", 1: "Create", 2: "Update", 3: "Close", 99: "Other"},
    3002: {0: "Unknown", 1: "Logon", 2: "Logoff", 3: "Authentication Ticket",
           4: "Service Ticket Request", 99: "Other"},
    4001: {0: "Unknown", 1: "Open", 2: "Close", 3: "Reset", 4: "Fail", 5: "Refuse", 6: "Traffic", 99: "Other"},
    4002: {0: "Unknown", 1: "Connect", 2: "Delete", 3: "Get", 4: "Head", 5: "Options", 6: "Post", 7: "Put",
           8: "Trace", 99: "Other"},
    4003: {0: "Unknown", 1: "Query", 2: "Response", 6: "Traffic", 99: "Other"},
}
SEVERITY = {0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical", 6: "Fatal",
            99: "Other"}
DISPOSITION = {0: "Unknown", 1: "Allowed", 2: "Blocked", 3: "Quarantined", 4: "Isolated", 5: "Deleted",
               6: "Dropped", 7: "Custom Action", 8: "Approved", 9: "Restored", 10: "Exonerated",
               15: "Detected", 16: "No Action", 17: "Logged", 99: "Other"}
ACTION = {0: "Unknown", 1: "Allowed", 2: "Denied", 99: "Other"}
# The action that each disposition means.
DISPOSITION_ACTION = {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 8: 1, 15: 1, 16: 1, 17: 1}
PROTOCOLS = {"icmp": 1, "igmp": 2, "tcp": 6, "udp": 17, "gre": 47, "esp": 50, "ah": 51, "icmpv6": 58,
             "sctp": 132}
DIRECTION = {0: "Unknown", 1: "Inbound", 2: "Outbound", 3: "Lateral", 99: "Other"}
WELL_KNOWN_PORTS = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 67: "dhcp", 69: "tftp",
    80: "http", 88: "kerberos", 110: "pop3", 123: "ntp", 135: "msrpc", 137: "netbios-ns", 139: "netbios-ssn",
    143: "imap", 161: "snmp", 389: "ldap", 443: "https", 445: "smb", 465: "smtps", 514: "syslog",
    587: "submission", 636: "ldaps", 993: "imaps", 995: "pop3s", 1433: "mssql", 1521: "oracle", 1723: "pptp",
    3306: "mysql", 3389: "rdp", 5432: "postgres", 5900: "vnc", 6379: "redis", 8080: "http-alt",
    8443: "https-alt", 9200: "elasticsearch",
}
RISKY_PORTS = (21, 23, 135, 137, 139, 445, 1433, 3306, 3389, 5900, 6379)
INTERNAL_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "fc00::/7")
OCSF_VERSION = "1.3.0"
SCHEMA_VERSION = "1.0.0"
CEF_SEVERITY = {0: 0, 1: 1, 2: 3, 3: 5, 4: 7, 5: 9, 6: 10}
SNIPPET_LIMIT = 4000


@lru_cache(maxsize=1)
def event_schema() -> T.StructType:
    return T.StructType.fromDDL(EVENT_DDL)


@lru_cache(maxsize=1)
def leaf_types() -> dict[str, str]:
    """Dotted path -> SQL type for every scalar of the event (needs a running session)."""
    out: dict[str, str] = {}

    def walk(struct: T.StructType, prefix: str) -> None:
        for f in struct.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, path)
            elif not isinstance(f.dataType, T.MapType):
                out[path] = f.dataType.simpleString()

    walk(event_schema(), "")
    return out
