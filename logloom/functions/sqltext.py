"""Small helpers that write Spark SQL expression text.

The compiled parsers are ordinary Catalyst expressions.  They are written as SQL
text (one ``expr`` call per column) because building thousands of nodes through
the Python Column API costs seconds of driver time per query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

_MISSING_GROUP_SEP = "\x01"


def q(value) -> str:
    """SQL string literal for any Python value (``None`` becomes NULL)."""
    if value is None:
        return "CAST(NULL AS STRING)"
    text = str(value)
    out = ["'"]
    for ch in text:
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'":
            out.append("\\'")
        elif ch == "\n":
            out.append("\\n")
        elif ch == "\r":
            out.append("\\r")
        elif ord(ch) < 32:
            out.append(f"\\u{ord(ch):04x}")
        else:
            out.append(ch)
    out.append("'")
    return "".join(out)


def str_array(values: Iterable) -> str:
    items = [q(v) for v in values]
    return "array(" + ", ".join(items) + ")" if items else "CAST(array() AS ARRAY<STRING>)"


def str_map(table: Mapping) -> str:
    """Literal string map; folded to a constant by the optimizer."""
    parts = [f"{q(k)}, {q(v)}" for k, v in table.items()]
    return "map(" + ", ".join(parts) + ")" if parts else "CAST(map() AS MAP<STRING,STRING>)"


def lookup(table: Mapping, key_sql: str) -> str:
    return f"element_at({str_map(table)}, {key_sql})"


def case(branches: Iterable[tuple[str, str]], default: str = "NULL") -> str:
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
    return f"CASE {body} ELSE {default} END" if body else default


def let(bindings: Mapping[str, str], var: str, body: str) -> str:
    """Bind sub-expressions once inside a lambda (projections cannot nest there)."""
    cols = ", ".join(f"{sql} AS `{name}`" for name, sql in bindings.items())
    return f"element_at(transform(array(struct({cols})), {var} -> {body}), 1)"


def nest(stages: list[Callable], outer: Callable[[str], str], result: Callable, tag: str = "v") -> str:
    """Chain stage functions inside one expression.

    A stage maps a reference function (column name -> SQL text) to new columns.
    ``result`` gets the final reference function and returns the value text.
    """

    def build(i: int, ref: Callable[[str], str]) -> str:
        if i == len(stages):
            return result(ref)
        cols = stages[i](ref)
        if not cols:
            return build(i + 1, ref)
        var = f"{tag}{i}"

        def nref(name: str, _cols=frozenset(cols), _var=var, _ref=ref) -> str:
            return f"{_var}.`{name}`" if name in _cols else _ref(name)

        return let(cols, var, build(i + 1, nref))

    return build(0, outer)


def last_wins_map(entries: str) -> str:
    """MAP from array<struct<key,value>>; the last entry of a repeated key is kept."""
    deduped = (
        f"filter({entries}, (e, i) -> NOT array_contains(slice({entries}.key, i + 2, size({entries})), e.key))"
    )
    return (
        f"CASE WHEN {entries} IS NULL THEN NULL"
        f" WHEN size(array_distinct({entries}.key)) = size({entries}) THEN map_from_entries({entries})"
        f" ELSE map_from_entries({deduped}) END"
    )


def entry(key_sql: str, value_sql: str) -> str:
    return f"struct({key_sql} AS key, {value_sql} AS value)"


WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(s: str) -> str:
    return f"btrim({s}, {q(WS)})"


def lstrip(s: str) -> str:
    return f"ltrim({q(WS)}, {s})"


def groups(s: str, java_pattern: str, n_groups: int, anchored: bool) -> str:
    """All groups of the first match with ONE regex pass.

    Yields ``array('', g1, ..., gn)`` on a match and a one-element array
    otherwise.  A text that itself holds the separator takes the exact
    per-group route.
    """
    flags, body = _split_flags(java_pattern)
    head = "" if anchored else "\\A[\\s\\S]*?"
    whole = f"{flags}{head}(?:{body})[\\s\\S]*\\z"
    repl = "".join(f"{_MISSING_GROUP_SEP}${i}" for i in range(1, n_groups + 1))
    fast = f"split(regexp_replace({s}, {q(whole)}, {q(repl)}), {q(_MISSING_GROUP_SEP)}, -1)"
    slow = (f"CASE WHEN {s} RLIKE {q(java_pattern)} THEN concat(array(''), transform(sequence(1, {n_groups}),"
            f" i -> regexp_extract({s}, {q(java_pattern)}, i))) ELSE array('') END")
    return f"CASE WHEN contains({s}, {q(_MISSING_GROUP_SEP)}) THEN {slow} ELSE {fast} END"


def settled(sql: str) -> str:
    """Marks a column as not deterministic, without changing it.

    Filters on the column would otherwise be pushed through every projection
    below, repeating the whole computation inside the predicate at each level.
    """
    return f"CASE WHEN monotonically_increasing_id() >= 0 THEN {sql} END"


def _split_flags(pattern: str) -> tuple[str, str]:
    m = re.match(r"\(\?[a-z]+\)", pattern)
    return (m.group(0), pattern[m.end():]) if m else ("", pattern)
