"""Parser definitions as data: one plan judges any number of definitions.

``pipeline`` compiles a known parser set into expressions. Candidates of the heal loop are rows of a table, many
and short-lived; here a definition is a value, ``rules`` (maps and arrays), and the expressions look everything up
in it. The plan's size depends on neither their number nor their content. A definition is prepared once, by a
small helper per row of the definition table; lines never meet Python.
"""

from __future__ import annotations

import json
import re

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import port
from ..functions.sqltext import case, entry, last_wins_map, let, lookup, lstrip, q, settled
from ..operators import tokenizers as tk
from ..operators.envelope import add_envelope
from ..operators.fingerprint import expected_text
from .lineage import cut
from .normalizer import Normalizer, to_int
from .pipeline import Flow, _prepared
from .registry import check_definition, complete

_PATTERN = "java STRING, whole STRING, replacement STRING, names ARRAY<STRUCT<name STRING, at INT, optional BOOLEAN>>"
RULES = (
    "problem STRING, source_id STRING, priority INT, channels ARRAY<STRING>, class_uid STRING, kind STRING, on_raw BOOLEAN,"
    " prints ARRAY<ARRAY<STRUCT<kind STRING, key STRING, value STRING>>>,"
    f" patterns ARRAY<STRUCT<{_PATTERN}, static MAP<STRING,STRING>>>, pair STRING,"
    " layout STRUCT<delimiter STRING, quotechar STRING, record STRING, cell STRING, quoted STRING, separator STRING>,"
    f" columns ARRAY<STRING>, least INT, extracts ARRAY<STRUCT<source STRING, {_PATTERN}>>, static MAP<STRING,STRING>,"
    " fields ARRAY<STRUCT<path STRING, tokens ARRAY<STRING>>>,"
    " steps ARRAY<STRUCT<path STRING, source STRING, table MAP<STRING,STRING>, fallback STRING>>, mapped_fields INT")
#: A disjunction of this many conjunctions at most; a fingerprint that needs more is reported.
MOST_PRINTS = 256


# ---------------------------------------------------------------- one definition
def _text(value) -> str | None:
    return None if value is None else str(value)


def _pattern(pattern: str) -> dict:
    if re.search(r"\(\?\(", pattern):
        raise ValueError("conditional groups are not supported")
    p = port(pattern)
    flags, body = re.match(r"(\(\?[a-z]+\))(.*)", p.java, re.DOTALL).groups()
    head = "" if p.anchored else "\\A[\\s\\S]*?"
    return {"java": p.java, "whole": f"{flags}{head}(?:{body})[\\s\\S]*\\z",
            "replacement": "".join(f"\x01${i}" for i in range(1, p.n_groups + 1)) or "\x01",
            "names": [{"name": n, "at": i, "optional": n in p.optional} for n, i in p.names]}


def _prints(fp: dict) -> list[list[dict]]:
    """A fingerprint as any-of-all."""
    if fp["type"] == "any":
        return [c for rule in fp["rules"] for c in _prints(rule)]
    if fp["type"] == "all":
        out: list[list[dict]] = [[]]
        for rule in fp["rules"]:
            out = [a + b for a in out for b in _prints(rule)]
            if len(out) > MOST_PRINTS:
                raise ValueError("fingerprint has too many alternatives")
        return out
    key, value = fp.get("key"), fp.get("pattern")
    if fp["type"] == "regex":
        value = port(fp["pattern"]).java
    if fp["type"] == "json_key":
        value = expected_text(fp["value"]) if "value" in fp else None
    return [[{"kind": fp["type"], "key": _text(key), "value": value}]]


def rules_of(text: str | None) -> dict:
    """One definition (JSON or YAML text) as RULES; ``problem`` says why it can't be used."""
    try:
        doc = yaml.safe_load(text) if text else None
    except yaml.YAMLError as e:
        return {"problem": f"YAML syntax error: {e}"}
    problem = check_definition(doc)
    if problem:
        return {"problem": problem, "source_id": _text(doc.get("source_id")) if isinstance(doc, dict) else None}
    d = complete(doc)
    try:
        return _rules(d)
    except (ValueError, KeyError, TypeError, AttributeError, re.error) as e:
        return {"problem": str(e), "source_id": _text(d["source_id"])}


def _rules(d: dict) -> dict:
    spec, m, ocsf = d["tokenize"], d["mapping"], d["ocsf"] or {}
    fields: dict[str, list[str]] = {}
    for token, dest in reversed(list((m.get("fields") or {}).items())):
        for path in dest if isinstance(dest, list) else [dest]:
            fields.setdefault(path, []).append(str(token))
    lowered = lambda table: {str(k).lower(): _text(v) for k, v in (table or {}).items()}
    steps = []
    for token, table in (m.get("values") or {}).items():
        dest = (m.get("fields") or {}).get(token, token)
        steps += [{"path": p, "source": None, "table": lowered(table), "fallback": None} for p in (
            dest if isinstance(dest, list) else [dest])]
    steps += [{"path": lk["to"], "source": str(lk["from"]), "table": lowered(lk.get("map")), "fallback": _text(lk.get("default"))}
              for lk in m.get("lookups") or []]
    delimiter = tk.delimiter_of(spec)
    quotechar = spec.get("quotechar", '"')
    return {
        "problem": None, "source_id": str(d["source_id"]), "priority": int(d["priority"]), "channels": [str(c) for c in d["channels"]],
        "class_uid": _text(ocsf.get("class_uid") or 0), "kind": spec["type"], "on_raw": spec.get("on") == "raw",
        "prints": _prints(d["fingerprint"]),
        "patterns": [{**_pattern(e["pattern"]), "static": {k: _text(v) for k, v in e["static"].items()}} for e in
                     (tk.patterns_of(spec) if spec["type"] == "regex" else [])],
        "pair": port(spec["pair_regex"]).java if spec["type"] == "kv" and spec.get("pair_regex") else None,
        "layout": {"delimiter": delimiter, "quotechar": quotechar, **tk.csv_patterns(delimiter, quotechar)},
        "columns": tk.csv_names(spec), "least": tk.csv_least(spec),
        "extracts": [{"source": str(ex["from"]), **_pattern(ex["pattern"])} for ex in m.get("extract") or []],
        "static": {k: _text(v) for k, v in (ocsf.get("static") or {}).items()},
        "fields": [{"path": p, "tokens": t} for p, t in fields.items()], "steps": steps,
        "mapped_fields": sum(not p.startswith(("metadata.", "message", "device.")) for p in fields),
    }


def with_rules(definitions: DataFrame, definition: str = "definition", out: str = "rules") -> DataFrame:
    """Adds the prepared form of every definition text; the table is written out, so that it is prepared once."""
    return cut(definitions.withColumn(out, F.udf(rules_of, RULES)(F.col(definition).cast("string"))))


def live_definitions(spark, registry) -> DataFrame:
    """(source_id, position, definition) of a parser set in routing order."""
    rows = [(p["source_id"], i, json.dumps(p, default=str)) for i, p in enumerate(registry.parsers)]
    return spark.createDataFrame(rows, "source_id STRING, position INT, definition STRING")


# ---------------------------------------------------------------- lines
def prepared_lines(df: DataFrame) -> DataFrame:
    """Lines with all that doesn't depend on a definition: envelope, JSON and XML tokens."""
    cols = df.columns
    flow = Flow(add_envelope(_prepared(df)))
    flow.add({"_jt": tk.json_text("text"), "_jp": tk.json_text("payload")})
    flow.add({"_jtv": tk.json_variant("_jt"), "_jpv": tk.json_variant("_jp")})
    flow.add({"_jte": tk.json_entries("_jtv", "_jt"), "_jpe": tk.json_entries("_jpv", "_jp")})
    flow.add({"_json": last_wins_map("_jte")})
    flow.df = flow.df.withColumn("_xml", tk.xml_entries(F.expr("CASE WHEN contains(payload, '<') THEN payload END")))
    needed = [c for c in ("text", "channel", "event_id", "sha256", "raw_ref") if c not in cols]
    return flow.df.select(*cols, *needed, "payload", "_json", F.col("_jpe").alias("_json_entries"), "_xml")


def print_sql(rules: str) -> str:
    """Whether a definition's fingerprint accepts a prepared line."""
    child = "exists(map_keys(_json), k -> startswith(k, concat(l.key, '.')))"
    keyed = (f"contains(text, substring_index(l.key, '.', 1)) AND coalesce(CASE WHEN l.value IS NULL THEN"
             f" element_at(_json, l.key) IS NOT NULL OR {child} ELSE element_at(_json, l.key) = l.value END, false)")
    one = (f"CASE l.kind WHEN 'contains' THEN contains(text, l.value) WHEN 'startswith' THEN startswith({lstrip('text')}, l.value)"
           f" WHEN 'regex' THEN text RLIKE l.value ELSE {keyed} END")
    return f"coalesce(exists({rules}.prints, c -> forall(c, l -> coalesce({one}, false))), false)"


def _groups(s: str, p: str) -> str:
    """Entries of the named groups of one pattern; an empty array when it names none, NULL when it doesn't match."""
    slow = f"regexp_extract({s}, {p}.java, n.at)"
    fast = "get(g, n.at)"
    got = f"CASE WHEN contains({s}, '\\u0001') THEN {slow} ELSE {fast} END"
    split = f"CASE WHEN contains({s}, '\\u0001') THEN array('') ELSE split(regexp_replace({s}, {p}.whole, {p}.replacement), '\\u0001', -1) END"
    named = f"transform({p}.names, n -> struct(n.name AS key, CASE WHEN n.optional THEN nullif({got}, '') ELSE {got} END AS value))"
    return (f"CASE WHEN {s} RLIKE {p}.java THEN element_at(transform(array({split}), g ->"
            f" filter({named}, e -> e.value IS NOT NULL)), 1) END")


class Interpreted(Normalizer):
    """The stages of ``check_stages`` with the definition looked up in a column."""

    def __init__(self, rules: str = "rules"):
        super().__init__([])
        self.d = rules

    def _m(self, r, path: str) -> str:
        return f"element_at({r('mapped')}, {q(path)})"

    def _present(self, r, prefix: str) -> str:
        return f"exists(map_keys({r('mapped')}), k -> startswith(k, {q(prefix)}))"

    def token_stages(self, c: str):
        d = self.d

        def subject(r):
            return {"subject": f"CASE WHEN {d}.on_raw THEN {r('text')} ELSE {r('payload')} END"}

        def shape(r):
            s = r("subject")
            layout = {k: f"{d}.layout.{k}" for k in ("record", "cell", "quoted", "separator")}
            hit = f"get(filter({d}.patterns, p -> {s} RLIKE p.java), 0)"
            return {"hit": f"CASE WHEN {d}.kind = 'regex' THEN {hit} END",
                    "cells": f"CASE {d}.kind WHEN 'csv' THEN {tk.csv_cells_by(s, d + '.layout.delimiter', d + '.layout.quotechar', layout)}"
                             f" WHEN 'cef' THEN {tk.cef_cells(s)} WHEN 'leef' THEN {tk.leef_cells(s)} END"}

        def leef(r):
            return {"leef": f"CASE WHEN {d}.kind = 'leef' THEN {tk.leef_parts(r('cells'))} END"}

        def entries(r):
            s = r("subject")
            pairs = (f"transform(regexp_extract_all({s}, {d}.pair, 0), m -> struct(regexp_extract(m, {d}.pair, 1) AS key,"
                     f" regexp_extract(m, {d}.pair, 2) AS value))")
            return {"entries": case([
                (f"{d}.kind = 'regex'", _groups(s, r("hit"))),
                (f"{d}.kind = 'kv' AND {d}.pair IS NULL", tk.kv_entries(s)), (f"{d}.kind = 'kv'", tk.unquoted(pairs)),
                (f"{d}.kind = 'csv'", tk.csv_entries_by(r("cells"), f"{d}.columns", f"size({d}.columns)", f"{d}.least")),
                (f"{d}.kind = 'cef'", tk.cef_entries(r("cells"))), (f"{d}.kind = 'leef'", tk.leef_entries(r("leef"))),
                (f"{d}.kind = 'json'", r("_json_entries")), (f"{d}.kind = 'xml'", r("_xml"))], tk.NO_ENTRIES)}

        def tokens(r):
            return {"tokens0": last_wins_map(r("entries"))}

        def extracted(r):
            new = _groups("element_at(t, x.source)", "x")
            kept = "map_filter(t, (k, v) -> NOT array_contains(x.names.name, k))"
            step = let({"new": new}, "y", f"CASE WHEN y.new IS NULL THEN t ELSE map_concat({kept}, map_from_entries(y.new)) END")
            t = r("tokens0")
            return {"tokens": f"CASE WHEN {t} IS NULL OR size({d}.extracts) = 0 THEN {t} ELSE aggregate({d}.extracts, {t}, (t, x) -> {step}) END"}

        def usable(r):
            return {"usable": f"map_filter({r('tokens')}, (k, v) -> v <> '' AND v <> '-')"}

        return [subject, shape, leef, entries, tokens, extracted, usable]

    def mapping_stages(self, c: str, paths):
        d = self.d

        def fields(r):
            value = f"get(filter(transform(f.tokens, t -> element_at({r('usable')}, t)), v -> v IS NOT NULL), 0)"
            found = f"filter(transform({d}.fields, f -> {entry('f.path', value)}), e -> e.value IS NOT NULL)"
            return {"by_field": f"map_from_entries({found})"}

        def base(r):
            own = r("by_field")
            return {"mapped0": f"map_concat(map_filter({d}.static, (k, v) -> v IS NOT NULL AND NOT map_contains_key({own}, k)), {own})"}

        def steps(r):
            # a table translates the value under its path, a lookup sets it from a token
            key = f"lower(CASE WHEN s.source IS NULL THEN element_at(m, s.path) ELSE element_at({r('tokens')}, s.source) END)"
            new = f"coalesce(element_at(s.table, {key}), s.fallback)"
            put = let({"new": new}, "y", "CASE WHEN y.new IS NULL THEN m ELSE map_concat(map_filter(m, (k, v) -> k <> s.path), map(s.path, y.new)) END")
            done = f"aggregate({d}.steps, {r('mapped0')}, (m, s) -> {put})"
            variant = f"{r('hit')}.static"
            return {"mapped": f"CASE WHEN size({variant}) > 0 THEN map_concat(map_filter({done}, (k, v) -> NOT map_contains_key({variant}, k)),"
                              f" {variant}) ELSE {done} END"}

        return [fields, base, steps]

    def class_stage(self, c: str):
        return lambda r: {"class_raw": to_int(f"coalesce({self._m(r, 'class_uid')}, {self.d}.class_uid)")}

    def check_stages(self, c: str, enforce: bool):
        stages = self.token_stages(c) + self.mapping_stages(c, []) + [self.class_stage(c)]
        return stages + (self.contract_stages() if enforce else []) + [self.verdict_stage(c, enforce)]

    def by_parser(self, c: str, text_of, default: str = "NULL") -> str:
        """Of all per-parser texts only the tokenizer's message is asked for here."""
        return lookup(tk.ERRORS, f"{self.d}.kind")


def judged(df: DataFrame, rules: str = "rules", enforce: bool = True) -> DataFrame:
    """Prepared lines that carry a definition -> ``matched``, ``reason``, ``detail`` (NULL when it parses) and
    ``class_uid``. The reason is that of a parser set which holds this definition alone."""
    cols = df.columns
    flow = Flow(df).add({"matched": print_sql(rules), "_one": "1"})
    flow.run(Interpreted(rules).check_stages("_one", enforce), prefix="_x_")
    # settled: a filter on the outcome must not repeat the computation below it
    out = {"reason": settled("CASE WHEN NOT matched THEN 'no_parser_match' ELSE _x_fail END"),
           "detail": "CASE WHEN NOT matched THEN 'no fingerprint matched' ELSE _x_fail_detail END",
           "class_uid": f"CASE WHEN matched AND _x_fail IS NULL THEN {Normalizer.known_class('_x_class_raw')} END"}
    return flow.df.selectExpr(*[f"`{c}`" for c in cols], "matched", *[f"{v} AS {k}" for k, v in out.items()])


def claims(lines: DataFrame, definitions: DataFrame, keys: list[str], block: int = 64, rows: int = 50_000) -> DataFrame:
    """(keys, definition_id, source_id, ok, reason, detail, class_uid, prefers, priority) of every definition of ``definitions``
    (definition_id, rules) whose fingerprint accepts a line.

    The definitions meet the lines in blocks of about ``block``, each line once per block; only accepted ones become
    rows. The lines are dealt over tasks of about ``rows`` tries; their number is fixed, as few bytes may mean much work."""
    usable = definitions.filter("rules.problem IS NULL").select("definition_id", "rules")
    blocks = max(1, -(-usable.count() // block))
    packed = usable.groupBy(F.pmod(F.xxhash64("definition_id"), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct("definition_id", "rules")).alias("_defs"))
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() * blocks // rows))
    salts = max(2, 2 * tasks // blocks)  # two for each task of a block, so that hashing leaves few tasks empty
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ready = prepared_lines(lines)
    need = [*keys, *[c for c in ("text", "payload", "channel", "event_id", "sha256", "raw_ref", "_json", "_json_entries", "_xml") if c not in keys]]
    dealt = ready.select(*need, F.pmod(F.xxhash64(*keys, "text"), F.lit(salts)).cast("int").alias("_salt")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = dealt.repartition(tasks, "_block", "_salt").join(packed.repartition(tasks, "_block", "_salt"), ["_block", "_salt"])
    met = met.withColumn("_d", F.explode(F.expr(f"filter(_defs, x -> {print_sql('x.rules')})"))).drop("_defs", "_block", "_salt")
    met = met.select("*", F.col("_d.definition_id").alias("definition_id"), F.col("_d.rules").alias("rules")).drop("_d")
    out = judged(met)
    return out.selectExpr(*[f"`{k}`" for k in keys], "definition_id", "rules.source_id AS source_id", "reason IS NULL AS ok", "reason", "detail",
                          "class_uid", "coalesce(array_contains(rules.channels, channel), false) AS prefers", "rules.priority AS priority")
