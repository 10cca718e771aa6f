"""Raw events -> normalized events and quarantine, in one pass without a shuffle.

raw -> text -> envelope -> fingerprints -> candidate order -> first candidate
that tokenizes and validates -> full normalization of that candidate.

The first candidate runs as compiled projections.  An event it fails on tries its
other candidates inside one nested expression, so there is no limit on their
number and still one scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqltext import case, nest, settled
from ..operators import fingerprint as fpo
from ..operators import tokenizers as tk
from ..operators.archive import replay_source
from ..operators.dlq import quarantine
from ..operators.envelope import add_envelope, envelope_view
from ..schema import event_schema
from .normalizer import Normalizer, leaf
from .registry import Registry



def prepare_session(spark) -> None:
    """Session settings a compiled parse relies on.

    Times are UTC.  Constraint propagation compares every alias of a plan with
    every other; on a plan of hundreds of aliases that takes minutes of driver
    time and finds nothing, so it is switched off.  Table keys are compared in
    lower case; the ICU word-break mapping costs half of the parse and only
    differs for a few letters outside ASCII.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    spark.conf.set("spark.sql.icu.caseMappings.enabled", "false")
    # both rules trace a join key back through every projection to the scan, which
    # takes minutes for a parsed key and cannot help (a parsed key prunes nothing)
    spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")


class Flow:
    """Applies stages as projections over a DataFrame, one select per stage."""

    def __init__(self, df: DataFrame):
        self.df = df

    def ref(self, prefix: str = "", aliases: dict | None = None) -> Callable[[str], str]:
        cols = set(self.df.columns)

        def r(name: str) -> str:
            if aliases and name in aliases:
                return aliases[name]
            if prefix + name in cols:
                return f"`{prefix}{name}`"
            if name in cols:
                return f"`{name}`"
            raise KeyError(f"stage needs column {name}")

        return r

    def add(self, cols: dict[str, str], prefix: str = "") -> Flow:
        if cols:
            fresh = {prefix + k: v for k, v in cols.items()}
            keep = [f"`{c}`" for c in self.df.columns if c not in fresh]
            self.df = self.df.selectExpr(*keep, *[f"{v} AS `{k}`" for k, v in fresh.items()])
        return self

    def run(self, stages, prefix: str = "", aliases: dict | None = None) -> Flow:
        for stage in stages:
            self.add(stage(self.ref(prefix, aliases)), prefix)
        return self

    def drop(self, *names: str) -> Flow:
        self.df = self.df.drop(*names)
        return self


# ---------------------------------------------------------------- input
def decode_utf8(df: DataFrame, raw: str = "raw", out: str = "text") -> DataFrame:
    """Bytes -> text with replacement characters; the bytes stay."""
    return df.withColumn(out, F.expr(f"make_valid_utf8(CAST(`{raw}` AS STRING))"))


_INPUTS = {"channel": "CAST(NULL AS STRING)", "source_hint": "CAST(NULL AS STRING)",
           "event_id": "CAST(NULL AS STRING)", "sha256": "CAST(NULL AS STRING)",
           "raw_ref": "CAST(NULL AS STRING)", "size_bytes": "CAST(NULL AS BIGINT)",
           "ingest_time": "current_timestamp()"}


def _prepared(df: DataFrame) -> DataFrame:
    prepare_session(df.sparkSession)
    if "text" not in df.columns:
        df = decode_utf8(df)
    missing = [f"{sql} AS {name}" for name, sql in _INPUTS.items() if name not in df.columns]
    if missing:
        df = df.selectExpr("*", *missing)
    return df.withColumn("ingest_us", F.expr("unix_micros(CAST(ingest_time AS TIMESTAMP))"))


# ---------------------------------------------------------------- routing
def _with_json(flow: Flow, registry: Registry) -> Flow:
    keys = sorted({k for p in registry.parsers for k in fpo.json_keys_of(p["fingerprint"])})
    if keys:
        guard = " OR ".join(f"contains(text, {fpo.q(k)})" for k in keys)
        flow.add({"_jtext": f"CASE WHEN {guard} THEN {tk.json_text('text')} END"})
        flow.add({"_jv0": tk.json_variant("_jtext")})
        flow.add({"_jv": "CASE WHEN try_variant_get(_jv0, '$[1]', 'variant') IS NULL THEN _jv0 END",
                  "_jrep": f"CASE WHEN _jv0 IS NULL AND _jtext IS NOT NULL THEN {tk.json_repeated('_jtext')} END"})
    return flow


def _with_matches(flow: Flow, registry: Registry) -> Flow:
    _with_json(flow, registry)
    return flow.add({f"m_{i}": f"coalesce({fpo.match_sql(p['fingerprint'], 'text')}, false)"
                     for i, p in enumerate(registry.parsers)})


def _prefers(p: dict) -> str:
    names = ", ".join(fpo.q(c) for c in p["channels"])
    return f"coalesce(channel IN ({names}), false)" if names else "false"


def _with_candidates(flow: Flow, registry: Registry, full: bool = False) -> Flow:
    """``c1`` first candidate, ``nc`` how many, ``cands`` all of them (only when several)."""
    ps = list(enumerate(registry.parsers))
    flow.add({"nc": " + ".join(f"CAST(m_{i} AS INT)" for i, _ in ps) or "0",
              "c1": case([(f"m_{i} AND {_prefers(p)}", str(i)) for i, p in ps if p["channels"]] +
                         [(f"m_{i}", str(i)) for i, _ in ps], "CAST(NULL AS INT)")})
    ordered = ([f"CASE WHEN m_{i} AND {_prefers(p)} THEN {i} END" for i, p in ps if p["channels"]] +
               [f"CASE WHEN m_{i} AND NOT {_prefers(p)} THEN {i} END" for i, p in ps])
    several = f"array_compact(array({', '.join(ordered)}))"
    flow.add({"cands": several if full else f"CASE WHEN nc > 1 THEN {several} END"})
    return flow.drop(*[f"m_{i}" for i, _ in ps])


def candidates(df: DataFrame, registry: Registry) -> DataFrame:
    """Adds ``candidates`` ARRAY<STRING>: matching parsers in routing order."""
    cols = df.columns
    flow = Flow(_prepared(df))
    _with_matches(flow, registry)
    _with_candidates(flow, registry, full=True)
    ids = fpo.q
    names = "array(" + ", ".join(ids(s) for s in registry.source_ids()) + ")"
    return flow.df.selectExpr(*[f"`{c}`" for c in cols], f"transform(cands, c -> get({names}, c)) AS candidates")


def _routed(df: DataFrame, registry: Registry, norm: Normalizer, enforce: bool) -> Flow:
    """Decides the winning parser ``w`` and keeps its tokens."""
    flow = Flow(_prepared(df))
    flow.df = add_envelope(flow.df)
    _with_matches(flow, registry)
    json_ids = [i for i, p in enumerate(registry.parsers) if p["tokenize"]["type"] == "json"]
    xml_ids = [i for i, p in enumerate(registry.parsers) if p["tokenize"]["type"] == "xml"]
    if json_ids:
        any_json = " OR ".join(f"m_{i}" for i in json_ids)
        subject = "text" if all(registry.parsers[i]["tokenize"].get("on") == "raw" for i in json_ids) else "payload"
        flow.add({"_jptext": f"CASE WHEN {any_json} THEN {tk.json_text(subject)} END"})
        same = "_jptext = _jtext AND _jv IS NOT NULL" if "_jv" in flow.df.columns else "false"
        shared = "_jv" if "_jv" in flow.df.columns else "NULL"
        flow.add({"_jpv": f"CASE WHEN {same} THEN {shared} ELSE {tk.json_variant('_jptext')} END"})
    if xml_ids:
        any_xml = " OR ".join(f"m_{i}" for i in xml_ids)
        flow.df = flow.df.withColumn("_xml", tk.xml_entries(F.expr(f"CASE WHEN {any_xml} THEN payload END")))
    _with_candidates(flow, registry)
    flow.drop("_jtext", "_jv0", "_jv", "_jrep")

    keep = ("tokens", "usable", "variant", "fail", "fail_detail")

    before = set(flow.df.columns)
    flow.run(norm.check_stages("c1", enforce), prefix="a1_")
    wanted = before | {f"a1_{k}" for k in keep}
    flow.drop(*[c for c in flow.df.columns if c not in wanted])
    has_variant = "a1_variant" in flow.df.columns
    carried = ("tokens", "usable", "variant") if has_variant else ("tokens", "usable")
    several = len(registry.parsers) > 1
    if several:
        def result(r):
            parts = ", ".join(f"{r(k)} AS {k}" for k in carried)
            return f"struct(k AS c, {r('fail')} IS NULL AS ok, {parts})"

        outer = flow.ref()
        one = nest(norm.check_stages("c2", enforce), lambda name: "k" if name == "c2" else outer(name), result)
        flow.add({"_rest": f"CASE WHEN nc > 1 AND a1_fail IS NOT NULL THEN"
                           f" get(filter(transform(slice(cands, 2, nc), k -> {one}), x -> x.ok), 0) END"})
    first_ok = "nc > 0 AND a1_fail IS NULL"
    flow.add({"w": f"CASE WHEN {first_ok} THEN c1 ELSE {'_rest.c' if several else 'CAST(NULL AS INT)'} END",
              **{k: f"CASE WHEN {first_ok} THEN a1_{k} ELSE {'_rest.' + k if several else 'NULL'} END"
                 for k in carried}})
    return flow.drop("_rest", "cands", "a1_tokens", "a1_usable", "a1_variant", "_jptext", "_jpv", "_xml")


def _outcome(flow: Flow, registry: Registry) -> Flow:
    sid = case([(f"c1 = {i}", fpo.q(p["source_id"])) for i, p in enumerate(registry.parsers)], "NULL")
    return flow.add({
        "reason": settled("CASE WHEN nc = 0 THEN 'no_parser_match' WHEN w IS NULL THEN a1_fail END"),
        "detail": "CASE WHEN nc = 0 THEN 'no fingerprint matched' WHEN w IS NULL THEN a1_fail_detail END",
        "parser_id": f"CASE WHEN nc > 0 AND w IS NULL THEN {sid} END",
    })


def route(df: DataFrame, registry: Registry, enforce: bool = True) -> DataFrame:
    """Adds ``source_id`` of the winner, or ``reason``/``detail``/``parser_id`` of the failure."""
    cols = df.columns
    flow = _outcome(_routed(df, registry, Normalizer(registry.parsers), enforce), registry)
    sid = case([(f"w = {i}", fpo.q(p["source_id"])) for i, p in enumerate(registry.parsers)], "CAST(NULL AS STRING)")
    return flow.df.selectExpr(*[f"`{c}`" for c in cols], f"{sid} AS source_id", "reason", "detail", "parser_id")


def tokenize(df: DataFrame, registry: Registry) -> DataFrame:
    """Adds ``parser`` (first candidate) and its ``tokens`` (NULL when they do not parse)."""
    cols = df.columns
    flow = _routed(df, registry, Normalizer(registry.parsers), enforce=False)
    sid = case([(f"w = {i}", fpo.q(p["source_id"])) for i, p in enumerate(registry.parsers)], "CAST(NULL AS STRING)")
    flow.add({"parser": settled(sid)})
    return flow.df.selectExpr(*[f"`{c}`" for c in cols], "parser", "tokens")


# ---------------------------------------------------------------- events
def parse_flat(df: DataFrame, registry: Registry, enforce: bool = True, **options) -> DataFrame:
    """Input columns plus every event leaf as its own column (dots become ``__``).

    Nothing a query does not read is computed, which a struct would prevent.
    """
    cols = df.columns
    norm = Normalizer(registry.parsers, **options)
    flow = _routed(df, registry, norm, enforce)
    flow.run(norm.event_stages("w"))
    _outcome(flow, registry)
    leaves = _leaf_columns()
    ready = set(flow.df.columns)
    out = [f"`{c}`" for c in cols] + ["reason", "detail", "parser_id"]
    out += [f"CASE WHEN w IS NOT NULL THEN `{name}` END AS `{name}`"
            for name in leaves + ["unmapped", "extra"] if name in ready and name not in cols]
    out += [f"`env_{f}`" for f in ("format", "pri", "facility", "syslog_severity", "timestamp", "hostname", "app_name",
                                   "procid", "msgid", "structured_data", "time_us")]
    return flow.df.selectExpr(*out, "payload AS `_payload`")


def _leaf_columns() -> list[str]:
    from ..schema import leaf_types
    return [leaf(p) for p in leaf_types() if not p.startswith("metadata.envelope.")]


def _struct_sql(field: T.DataType, path: str, ready: set) -> tuple[str, list[str]]:
    """(value, columns inside): a nested value is NULL when nothing inside is set."""
    if not isinstance(field, T.StructType):
        name, typ = leaf(path), field.simpleString()
        return (f"CAST(`{name}` AS {typ})", [name]) if name in ready else (f"CAST(NULL AS {typ})", [])
    if path == "metadata.envelope":
        return envelope_view(), ["env_format"]
    members, inside = [], []
    for f in field.fields:
        value, names = _struct_sql(f.dataType, f"{path}.{f.name}", ready)
        members.append(f"{value} AS `{f.name}`")
        inside += names
    test = " OR ".join(f"`{n}` IS NOT NULL" for n in inside) or "false"
    return f"CASE WHEN {test} THEN struct({', '.join(members)}) END", inside


def to_events(flat: DataFrame) -> DataFrame:
    """Flat frame -> the event table (one column per top-level attribute)."""
    return to_events_with(flat)


def to_events_with(flat: DataFrame, *keep: str) -> DataFrame:
    """The event table with some input columns kept in front."""
    ready = set(flat.columns)
    out = [f"`{c}`" for c in keep]
    out += [f"{_struct_sql(f.dataType, f.name, ready)[0]} AS `{f.name}`" for f in event_schema().fields]
    return flat.filter("reason IS NULL").selectExpr(*out)


def normalize(df: DataFrame, registry: Registry, enforce: bool = True, **options) -> DataFrame:
    """Raw events -> normalized event table; failures are left out."""
    return to_events(parse_flat(df, registry, enforce, **options))


def parse_or_quarantine(df: DataFrame, registry: Registry, enforce: bool = True) -> tuple[DataFrame, DataFrame]:
    """(normalized events, DLQ rows) of one batch of raw events.

    Both sides read the same frame: persist it first (``fan_out`` does) or write
    the raw table before, and neither side parses twice.
    """
    flat = parse_flat(_prepared(df).drop("ingest_us"), registry, enforce)
    return to_events(flat), quarantine(flat.filter("reason IS NOT NULL"))


def replay(pending: DataFrame, archive: DataFrame, registry: Registry) -> DataFrame:
    """Re-parses quarantined rows from their archived originals.

    Adds ``source_id`` (NULL when the row still fails) and ``still`` (the reason);
    failures are reported, not queued again.
    """
    originals = replay_source(pending, archive).withColumnRenamed("reason", "was")
    rows = originals.drop("parser_id").withColumnRenamed("raw_sha256", "sha256").withColumn(
        "size_bytes", F.expr("CAST(octet_length(raw) AS BIGINT)"))
    out = route(rows, registry)
    return out.withColumnRenamed("reason", "still")
