"""Syslog envelope: RFC 5424, RFC 3164, a bare <PRI>, or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timeparse as tp
from ..functions.sqltext import groups, lstrip, q, strip

# The two header grammars.  Group loops are possessive, so a long
# value cannot exhaust the executor's thread stack.
RFC5424 = (r"(?ds)^<(\d{1,3})>\d{1,2}\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+"
           r"(-|(?:\[(?:[^\]\\]|\\.)*+\])++)\s?(.*)$")
RFC3164 = (r"(?ds)^(?:<(\d{1,3})>)?\s*([A-Z][a-z]{2}\s+\d{1,2}(?:\s+\d{4})?\s+\d{2}:\d{2}:\d{2})\s+"
           r"([^\s:]+)\s*(?:([\w\-./]+)(?:\[(\d+)\])?:\s+|:\s+)?(.*)$")
PRI_ONLY = r"(?ds)^<(\d{1,3})>(.*)$"

FIELDS = ("format", "pri", "facility", "syslog_severity", "timestamp", "hostname", "app_name", "procid",
          "msgid", "structured_data")
_TYPES = {"pri": "INT", "facility": "INT", "syslog_severity": "INT"}


def pri_fields(pri: str) -> tuple[str, str]:
    """(facility, severity) of a priority value."""
    return f"({pri} DIV 8)", f"({pri} % 8)"


def add_envelope(df: DataFrame, text: str = "text", ingest: str = "ingest_time") -> DataFrame:
    """Adds ``env_*`` columns, ``env_time_us`` (BIGINT) and ``payload``."""
    keep = [f"`{c}`" for c in df.columns]
    bare = f"regexp_replace(`{text}`, '^\\\\x{{FEFF}}+', '')"
    df = df.selectExpr(*keep, f"{strip(bare)} AS _line")
    df = df.selectExpr(
        *keep, "_line",
        f"CASE WHEN startswith(_line, '<') THEN {groups('_line', RFC5424, 8, True)} ELSE array('') END AS _g5",
    )
    df = df.selectExpr(
        *keep, "_line", "_g5",
        f"CASE WHEN size(_g5) > 1 THEN array('') ELSE {groups('_line', RFC3164, 6, True)} END AS _g3",
    )
    df = df.selectExpr(
        *keep, "_line", "_g5", "_g3",
        f"CASE WHEN size(_g5) > 1 THEN 'rfc5424' WHEN size(_g3) > 1 THEN 'rfc3164'"
        f" WHEN _line RLIKE {q(PRI_ONLY)} THEN 'pri_only' END AS env_format",
    )

    def pick(from5: str | None, from3: str | None) -> str:
        return (f"CASE env_format WHEN 'rfc5424' THEN {from5 or 'NULL'}"
                f" WHEN 'rfc3164' THEN {from3 or 'NULL'} END")

    def dash(i: int) -> str:
        return f"nullif(_g5[{i}], '-')"

    pri = (f"try_cast(CASE env_format WHEN 'rfc5424' THEN _g5[1] WHEN 'rfc3164' THEN nullif(_g3[1], '')"
           f" WHEN 'pri_only' THEN regexp_extract(_line, {q(PRI_ONLY)}, 1) END AS INT)")
    df = df.selectExpr(
        *keep, "_line", "_g5", "_g3", "env_format",
        f"{pri} AS env_pri",
        f"{pick('_g5[2]', '_g3[2]')} AS env_timestamp",
        f"{pick(dash(3), '_g3[3]')} AS env_hostname",
        f"{pick(dash(4), chr(10) + 'nullif(_g3[4], ' + q('') + ')')} AS env_app_name",
        f"{pick(dash(5), 'nullif(_g3[5], ' + q('') + ')')} AS env_procid",
        f"{pick(dash(6), None)} AS env_msgid",
        f"{pick(dash(7), None)} AS env_structured_data",
        f"CASE env_format WHEN 'rfc5424' THEN regexp_replace(_g5[8], '^\\\\x{{FEFF}}+', '')"
        f" WHEN 'rfc3164' THEN _g3[6] WHEN 'pri_only' THEN regexp_extract(_line, {q(PRI_ONLY)}, 2)"
        f" ELSE _line END AS payload",
    )
    facility, severity = pri_fields("env_pri")
    now = f"unix_micros(CAST(`{ingest}` AS TIMESTAMP))"
    return df.selectExpr(
        *keep, "env_format", "env_pri",
        f"CAST({facility} AS INT) AS env_facility", f"CAST({severity} AS INT) AS env_syslog_severity",
        "env_timestamp", "env_hostname", "env_app_name", "env_procid", "env_msgid", "env_structured_data",
        f"CASE env_format WHEN 'rfc5424' THEN {tp.iso_us('env_timestamp')}"
        f" WHEN 'rfc3164' THEN {tp.bsd_us('env_timestamp', now)} END AS env_time_us",
        "payload",
    )


def envelope_view(prefix: str = "env_") -> str:
    """JSON-safe envelope struct (NULL when the line has none), as SQL text."""
    members = ", ".join(f"`{prefix}{f}` AS `{f}`" for f in FIELDS)
    return (f"CASE WHEN {prefix}format IS NOT NULL THEN struct({members},"
            f" {tp.iso_text(prefix + 'time_us')} AS `time`) END")


def parse_envelope(df: DataFrame, text: str = "text", ingest: str = "ingest_time") -> DataFrame:
    """Table of lines -> same rows with ``envelope`` STRUCT and ``payload``."""
    out = add_envelope(df, text, ingest)
    return out.select(*df.columns, F.expr(envelope_view()).alias("envelope"), "payload")
