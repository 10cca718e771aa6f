"""Structural signature of a line: the cluster key of the quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.sqltext import q, settled, strip
from .envelope import add_envelope
from .tokenizers import json_walk, json_variant

# The token shapes.  \w and \d of the original are Unicode classes.
_W = r"\p{L}\p{N}_"
IP_TOKEN = r"^\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}(?:[:/]\p{Nd}+)*$"
NUM_TOKEN = r"^[-+]?\p{Nd}+(?:[.,:]\p{Nd}+)*$"
HEX_TOKEN = r"^(?:0x)?[0-9a-fA-F]{8,}$"
WORD_TOKEN = rf"^[A-Za-z%_][{_W}%\-]*:?$"
KV_KEY = rf"([A-Za-z_][{_W}.\-]*)="
XML_NAME = rf"^<\s*([{_W}:.\-]+)"


def shape_sql(tok: str) -> str:
    """Shape of one token: <ip> <num> <hex> <kv>, a masked word, or <*>."""
    return (f"CASE WHEN {tok} RLIKE {q(IP_TOKEN)} THEN '<ip>' WHEN {tok} RLIKE {q(NUM_TOKEN)} THEN '<num>'"
            f" WHEN {tok} RLIKE {q(HEX_TOKEN)} THEN '<hex>' WHEN contains({tok}, '=') THEN '<kv>'"
            f" WHEN length({tok}) <= 40 AND {tok} RLIKE {q(WORD_TOKEN)}"
            f" THEN regexp_replace({tok}, {q(chr(92) + 'p{Nd}')}, '#') ELSE '<*>' END")


def _count(s: str, ch: str) -> str:
    return f"(length({s}) - length(replace({s}, {q(ch)}, '')))"


def signature_columns(df: DataFrame, channel: str = "channel") -> DataFrame:
    """Adds ``cluster_id``, ``cluster_label``, ``format_guess`` to rows that carry
    ``payload`` and ``env_app_name``."""
    keep = [f"`{c}`" for c in df.columns]
    df = df.selectExpr(*keep, f"{strip('payload')} AS _p")
    df = df.selectExpr(*keep, "_p", f"CASE WHEN startswith(_p, '{{') THEN {json_variant('_p')} END AS _v")
    df = df.selectExpr(
        *keep, "_p",
        f"CASE WHEN _v IS NOT NULL THEN CASE WHEN try_variant_get(_v, '$[1]', 'variant') IS NULL THEN"
        f" array_sort(map_keys(try_variant_get(_v, '$[0]', 'map<string,variant>'))) END"
        f" WHEN startswith(_p, '{{') AND {json_walk('_p')} IS NOT NULL THEN"
        f" array_sort(array_distinct(map_keys(from_json(concat('[', _p, ']'), 'array<map<string,string>>')[0]))) END AS _keys")
    bars = ("split(CASE WHEN contains(_p, 'CEF:') THEN substr(_p, instr(_p, 'CEF:'))"
            " WHEN contains(_p, 'LEEF:') THEN substr(_p, instr(_p, 'LEEF:')) END, '\\\\|', -1)")
    df = df.selectExpr(
        *keep, "_p", "_keys",
        f"CASE WHEN _keys IS NULL THEN slice({bars}, 2, 2) END AS _hdr",
        f"CASE WHEN _keys IS NULL AND NOT contains(_p, 'CEF:') AND NOT contains(_p, 'LEEF:')"
        f" AND NOT startswith(_p, '<') THEN regexp_extract_all(_p, {q(KV_KEY)}, 1) END AS _kv")
    df = df.selectExpr(
        *keep, "_p", "_keys", "_hdr", "_kv",
        f"CASE WHEN _keys IS NOT NULL THEN 'json' WHEN contains(_p, 'CEF:') THEN 'cef'"
        f" WHEN contains(_p, 'LEEF:') THEN 'leef' WHEN startswith(_p, '<') THEN 'xml'"
        f" WHEN size(_kv) >= 3 THEN 'kv' WHEN {_count('_p', ',')} >= 5 AND {_count('_p', ',')} > {_count('_p', ' ')}"
        f" THEN 'csv' ELSE 'text' END AS _fmt")
    cols = f"({_count('_p', ',')} + 1)"
    shape = f"array_join(transform(slice(split(_p, '\\\\s+', 5), 1, 4), t -> {shape_sql('t')}), ' ')"
    shape = f"CASE WHEN _p = '' THEN '' ELSE {shape} END"
    tag = f"coalesce(nullif(regexp_extract(_p, {q(XML_NAME)}, 1), ''), '?')"
    df = df.selectExpr(
        *keep, "_fmt", "_keys", "_hdr", "_kv",
        f"CASE _fmt WHEN 'xml' THEN {tag} WHEN 'csv' THEN CAST({cols} AS STRING) WHEN 'text' THEN {shape} END AS _one")
    df = df.selectExpr(
        *keep, "_fmt",
        "CASE _fmt WHEN 'json' THEN concat('json:', array_join(slice(_keys, 1, 12), ','))"
        " WHEN 'cef' THEN concat('cef:', array_join(_hdr, '|')) WHEN 'leef' THEN concat('leef:', array_join(_hdr, '|'))"
        " WHEN 'kv' THEN concat('kv:', array_join(slice(_kv, 1, 4), ',')) ELSE concat(_fmt, ':', _one) END AS _key",
        "CASE _fmt WHEN 'json' THEN concat('JSON {', array_join(slice(_keys, 1, 5), ', '),"
        " CASE WHEN size(_keys) > 5 THEN ', …' ELSE '' END, '}')"
        " WHEN 'cef' THEN concat('CEF ', array_join(_hdr, ' / ')) WHEN 'leef' THEN concat('LEEF ', array_join(_hdr, ' / '))"
        " WHEN 'xml' THEN concat('XML <', _one, '>') WHEN 'csv' THEN concat('CSV (', _one, ' columns)')"
        " WHEN 'kv' THEN concat('key=value {', array_join(slice(_kv, 1, 4), ', '), ', …}') ELSE _one END AS _label")
    app = "coalesce(env_app_name, '')"
    key = f"concat(CASE WHEN {app} <> '' THEN concat('app=', {app}, '|') ELSE '' END, _key)"
    label = f"concat(CASE WHEN {app} <> '' THEN concat({app}, ': ') ELSE '' END, _label)"
    cluster = f"left(sha1(concat(coalesce(`{channel}`, ''), '|', {key})), 12)"
    return df.selectExpr(
        *keep, f"{settled(cluster)} AS cluster_id",
        f"left({label}, 120) AS cluster_label", "_fmt AS format_guess")


def signature(df: DataFrame, text: str = "text", channel: str = "channel", ingest: str = "ingest_time") -> DataFrame:
    """Table of lines -> same rows with cluster id, label and format guess."""
    full = signature_columns(add_envelope(df, text, ingest), channel)
    return full.select(*df.columns, "cluster_id", "cluster_label", "format_guess")
