"""Time parsing as SQL text.  Every result is BIGINT microseconds since the epoch, UTC."""

from __future__ import annotations

import re

from .sqltext import q

MICROS_PER_DAY = 86_400_000_000

# fixed values: the directives a time format may use, and their Spark spelling
_DIRECTIVES = {
    "%Y": "yyyy", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM", "%H": "H", "%M": "m", "%S": "s",
    "%y": "yy", "%I": "h", "%p": "a", "%j": "D", "%f": "SSSSSS", "%a": "EEE", "%A": "EEEE", "%Z": "zzz",
}


def zone_offset_micros(tz) -> int:
    """'UTC', 'Z', '+HH:MM', '-HHMM' -> offset; anything else counts as UTC."""
    m = re.fullmatch(r"([+-])(\d{2}):?(\d{2})", str(tz or ""))
    if not m:
        return 0
    size = (int(m[2]) * 60 + int(m[3])) * 60_000_000
    return size if m[1] == "+" else -size


def squeeze(s: str) -> str:
    return f"regexp_replace(trim({s}), '\\\\s+', ' ')"


def bsd_us(s: str, now_us: str) -> str:
    """'Jan  3 04:05:06' or 'Jan 3 2024 04:05:06'.

    Without a year the year of ``now_us`` is used, or the one before when that
    would lie a day or more in the future.
    """
    t = squeeze(s)
    fmt = "'yyyy MMM d H:m:s'"
    md = f"substring_index({t}, ' ', 2)"
    clock = f"substring_index({t}, ' ', -1)"
    year = f"year(timestamp_micros({now_us}))"

    def at(y: str) -> str:
        return f"unix_micros(try_to_timestamp(concat_ws(' ', {y}, {md}, {clock}), {fmt}))"

    with_year = f"unix_micros(try_to_timestamp({t}, 'MMM d yyyy H:m:s'))"
    return (
        f"CASE WHEN {s} RLIKE '^\\\\s*\\\\S+\\\\s+\\\\S+\\\\s+\\\\S+\\\\s+\\\\S+\\\\s*$' THEN {with_year}"
        f" WHEN {at(year)} - {now_us} >= {MICROS_PER_DAY} THEN {at('(' + year + ' - 1)')}"
        f" ELSE {at(year)} END"
    )


_ISO_GUARD = (
    "^\\\\d{4}-\\\\d{2}-\\\\d{2}([T ]\\\\d{2}:\\\\d{2}(:\\\\d{2}([.,]\\\\d{1,9})?)?"
    "(Z|[+-]\\\\d{2}(:?\\\\d{2})?)?)?$"
)


def iso_us(s: str, offset_us: int = 0) -> str:
    """ISO-8601; the zone of the text wins over the configured offset."""
    fixed = f"regexp_replace(regexp_replace({s}, ',', '.'), '([+-]\\\\d{{2}})(\\\\d{{2}})$', '$1:$2')"
    us = f"unix_micros(try_cast({fixed} AS TIMESTAMP))"
    if offset_us:
        us = f"({us} - CASE WHEN {s} RLIKE '(Z|[+-]\\\\d{{2}}:?\\\\d{{2}})$' THEN 0L ELSE {offset_us}L END)"
    return f"CASE WHEN {s} RLIKE '{_ISO_GUARD}' THEN {us} END"


def _epoch_us(s: str, micros_per_unit: str) -> str:
    number = f"try_cast(trim({s}) AS DECIMAL(30,9))"
    return f"try_cast(floor({number} * {micros_per_unit}) AS BIGINT)"


def value_us(s: str, fmt: str, now_us: str, offset_us: int = 0) -> str:
    """One value in one named or strptime-style format; NULL when it does not parse."""
    if fmt == "epoch":
        return _epoch_us(s, "1000000")
    if fmt == "epoch_ms":
        return _epoch_us(s, "1000")
    if fmt == "epoch_ns":
        return _epoch_us(s, "0.001")
    if fmt == "iso8601":
        return iso_us(s, offset_us)
    if fmt == "syslog":
        return bsd_us(s, now_us)
    pattern, zoned = _spark_pattern(fmt)
    text = squeeze(s)
    if zoned:
        return f"unix_micros(try_to_timestamp({text}, {q(pattern)}))"
    us = f"unix_micros(try_to_timestamp({text}, {q(pattern)}))"
    return f"({us} - {offset_us}L)" if offset_us else us


def _spark_pattern(fmt: str) -> tuple[str, bool]:
    out, i, zoned, quoted = [], 0, False, []

    def flush():
        if quoted:
            out.append("'" + "".join(quoted).replace("'", "''") + "'")
            quoted.clear()

    while i < len(fmt):
        pair = fmt[i:i + 2]
        if pair == "%z":
            flush()
            out.append("[XXX][XX]")
            zoned, i = True, i + 2
        elif pair in _DIRECTIVES:
            flush()
            out.append(_DIRECTIVES[pair])
            i += 2
        elif fmt[i].isalpha():
            quoted.append(fmt[i])
            i += 1
        else:
            flush()
            out.append(fmt[i])
            i += 1
    flush()
    return "".join(out), zoned


def iso_text(us: str) -> str:
    """Microseconds -> '2024-01-03T04:05:06.123456+00:00' (fraction only when not zero)."""
    return (
        f"concat(date_format(timestamp_micros({us}), 'yyyy-MM-dd\\'T\\'HH:mm:ss'),"
        f" CASE WHEN pmod({us}, 1000000L) = 0 THEN ''"
        f" ELSE concat('.', lpad(CAST(pmod({us}, 1000000L) AS STRING), 6, '0')) END, '+00:00')"
    )


def millis(us: str) -> str:
    return f"(({us} - pmod({us}, 1000L)) DIV 1000L)"
