"""The event contract as predicates: a list of violations per event."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import ip as ipf
from ..functions.sqltext import q
from ..schema import DIRECTION

# Formats an event must satisfy.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SHA256 = "^[0-9a-f]{64}$"
RAW_REF = "^(local|minio)://[^/]+/.+$"


def _quoted(s: str, limit: int | None = None) -> str:
    body = f"concat('\\'', {s}, '\\'')"
    return f"left({body}, {limit})" if limit else body


def rules(class_uid, src_ip, src_bad, src_port, dst_ip, dst_bad, dst_port, protocol_num, direction_id, code, has_src, has_dst,
          has_request, has_finding, uid, sha256, raw_ref, channel) -> list[tuple[str, str]]:
    """(violation predicate, message text) in contract order, as SQL."""
    out: list[tuple[str, str]] = []

    def bounds(path: str, value: str, low: int, high: int) -> None:
        out.append((f"{value} < {low}", f"concat('{path}: ', {value}, ' is less than the minimum of {low}')"))
        out.append((f"{value} > {high}", f"concat('{path}: ', {value}, ' is greater than the maximum of {high}')"))

    for side, addr, bad, port in (("src_endpoint", src_ip, src_bad, src_port), ("dst_endpoint", dst_ip, dst_bad, dst_port)):
        out.append((bad,
                    f"concat('{side}.ip: value ', {_quoted(addr, 60)}, ' does not match the expected format')"))
        bounds(f"{side}.port", port, 0, 65535)
    bounds("connection_info.protocol_num", protocol_num, 0, 255)
    allowed = ", ".join(map(str, DIRECTION))
    out.append((f"{direction_id} NOT IN ({allowed})",
                f"concat('connection_info.direction_id: ', {direction_id}, ' is not one of [{allowed}]')"))
    bounds("http_response.code", code, 100, 999)
    for name, value in (("raw_sha256", sha256), ("raw_ref", raw_ref), ("ingest_channel", channel)):
        out.append((f"{value} IS NULL", f"'metadata: \\'{name}\\' is a required property'"))
    missing = f"coalesce({uid}, '')"
    out.append((f"{uid} IS NULL OR NOT {uid} RLIKE {q(UUID)}",
                f"concat('metadata.uid: ', {_quoted(missing)}, ' is not a \\'uuid\\'')"))
    for name, value, pattern in (("raw_sha256", sha256, SHA256), ("raw_ref", raw_ref, RAW_REF)):
        out.append((f"NOT {value} RLIKE {q(pattern)}",
                    f"concat('metadata.{name}: ', {_quoted(value)}, ' does not match ', {q(repr(pattern))})"))
    out.append((f"{class_uid} = 4001 AND NOT ({has_src}) AND NOT ({has_dst})",
                "'<root>: needs one of src_endpoint / dst_endpoint'"))
    out.append((f"{class_uid} = 4002 AND NOT ({has_request})", "'<root>: \\'http_request\\' is a required property'"))
    out.append((f"{class_uid} = 2004 AND NOT ({has_finding})", "'<root>: \\'finding_info\\' is a required property'"))
    return out


def error_list(**kw) -> str:
    """ARRAY<STRING>; the messages are only built for rows that break a rule."""
    rs = rules(**kw)
    any_bad = " OR ".join(f"coalesce({bad}, false)" for bad, _ in rs)
    msgs = ", ".join(f"CASE WHEN {bad} THEN {msg} END" for bad, msg in rs)
    return f"CASE WHEN {any_bad} THEN array_compact(array({msgs})) ELSE CAST(array() AS ARRAY<STRING>) END"


def validate(df: DataFrame, out: str = "errors") -> DataFrame:
    """Adds the violations of normalized events (table with the event columns)."""
    has = {n: f"{n} IS NOT NULL" for n in ("src_endpoint", "dst_endpoint", "http_request", "finding_info")}
    sql = error_list(
        class_uid="class_uid", src_ip="src_endpoint.ip", src_bad="_src_bad", src_port="src_endpoint.port",
        dst_ip="dst_endpoint.ip", dst_bad="_dst_bad", dst_port="dst_endpoint.port", protocol_num="connection_info.protocol_num",
        direction_id="connection_info.direction_id", code="http_response.code", has_src=has["src_endpoint"],
        has_dst=has["dst_endpoint"], has_request=has["http_request"], has_finding=has["finding_info"],
        uid="metadata.uid", sha256="metadata.raw_sha256", raw_ref="metadata.raw_ref",
        channel="metadata.ingest_channel")
    bad = [f"{s}_endpoint.ip IS NOT NULL AND NOT {ipf.is_ip(f'{s}_endpoint.ip')} AS _{s}_bad" for s in ("src", "dst")]
    return df.selectExpr("*", *bad).selectExpr("*", f"{sql} AS `{out}`").drop("_src_bad", "_dst_bad")
