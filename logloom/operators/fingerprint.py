"""Routing predicates: one BOOLEAN expression per fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sqltext import let, lstrip, q
from .tokenizers import json_repeated, json_text, json_variant, regex_matches


def json_path(key: str) -> tuple[str, str | None]:
    """(nested path, flat path or None) into the wrapped document."""
    def seg(s: str) -> str:
        return "[" + '"' + s.replace('"', '\\"') + '"' + "]"

    nested = "$[0]" + "".join(seg(s) for s in key.split("."))
    return nested, ("$[0]" + seg(key) if "." in key else None)


def json_value(key: str, v: str, rep: str) -> str:
    """Text of a dotted key; ``rep``, a token map, serves documents with repeated keys."""
    nested, flat = json_path(key)
    parts = []
    if flat:
        parts.append(f"try_variant_get({v}, {q(flat)}, 'string')")
    parts.append(f"try_variant_get({v}, {q(nested)}, 'string')")
    # an object under the key has no text of its own in the map
    parts.append(f"element_at({rep}, {q(key)})")
    parts.append(f"CASE WHEN exists(map_keys({rep}), k -> startswith(k, {q(key + '.')})) THEN '{{}}' END")
    return "coalesce(" + ", ".join(parts) + ")"


def expected_text(value) -> str:
    """JSON spelling of a configured value."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def match_sql(fp: dict, text: str, v: str = "_jv", rep: str = "_jrep") -> str:
    kind = fp["type"]
    if kind == "contains":
        return f"contains({text}, {q(fp['pattern'])})"
    if kind == "startswith":
        return f"startswith({lstrip(text)}, {q(fp['pattern'])})"
    if kind == "regex":
        return regex_matches(text, fp["pattern"])
    if kind == "json_key":
        got = json_value(fp["key"], v, rep)
        test = f"{got} = {q(expected_text(fp['value']))}" if "value" in fp else f"{got} IS NOT NULL"
        guard = f"contains({text}, {q(fp['key'].split('.')[0])})"
        return f"CASE WHEN {guard} THEN coalesce({test}, false) ELSE false END"
    glue = " AND " if kind == "all" else " OR "
    rules = [match_sql(r, text, v, rep) for r in fp["rules"]]
    return "(" + glue.join(f"({r})" for r in rules) + ")" if rules else ("true" if kind == "all" else "false")


def json_keys_of(fp: dict) -> list[str]:
    if fp["type"] == "json_key":
        return [fp["key"].split(".")[0]]
    if fp["type"] in ("all", "any"):
        return [k for r in fp["rules"] for k in json_keys_of(r)]
    return []


def standalone_sql(fp: dict, text: str) -> str:
    """The predicate over a text column alone (parses JSON itself)."""
    jt = json_text(text)
    if not json_keys_of(fp):
        return match_sql(fp, text)
    # bound once: the document is parsed once whatever the fingerprint asks for
    parsed = let({"v": json_variant(jt), "jt": jt}, "j0", let(
        {"v": "j0.v", "rep": f"CASE WHEN j0.v IS NULL AND j0.jt IS NOT NULL THEN {json_repeated('j0.jt')} END"}, "j", match_sql(fp, text, "j.v", "j.rep")))
    return f"({parsed})"


def matches(fp: dict, text: str = "text") -> Column:
    """Column for ``df.filter`` / ``df.withColumn``."""
    return F.expr(standalone_sql(fp, f"`{text}`"))


def fp_contains(literal: str, text: str = "text") -> Column:
    return matches({"type": "contains", "pattern": literal}, text)


def fp_startswith(prefix: str, text: str = "text") -> Column:
    return matches({"type": "startswith", "pattern": prefix}, text)


def fp_regex(pattern: str, text: str = "text") -> Column:
    return matches({"type": "regex", "pattern": pattern}, text)


def fp_json_key(key: str, value=None, text: str = "text") -> Column:
    fp = {"type": "json_key", "key": key}
    if value is not None:
        fp["value"] = value
    return matches(fp, text)


def fp_all(rules, text: str = "text") -> Column:
    return matches({"type": "all", "rules": list(rules)}, text)


def fp_any(rules, text: str = "text") -> Column:
    return matches({"type": "any", "rules": list(rules)}, text)
