"""Payload tokenizers: one table of payloads in, one MAP<STRING,STRING> per row out.

Each format yields SQL text for ``array<struct<key,value>>`` (NULL when the
payload is not of that format); ``last_wins_map`` turns it into the token map.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import port
from ..functions.sqltext import case, entry, groups, last_wins_map, let, lstrip, q, str_array, strip

ENTRIES_TYPE = "ARRAY<STRUCT<key: STRING, value: STRING>>"
NO_ENTRIES = f"CAST(NULL AS {ENTRIES_TYPE})"
JSON_DEPTH = 5  # objects with more braces are walked token by token

# The pair grammars and header names.
KV_PAIR = r'([\w.\-]+)=("(?:[^"\\]|\\.)*+"|' + r"'[^']*'|[^\s,;]*)"
CEF_HEADER = ("cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name",
              "severity")
LEEF_HEADER = ("leef_version", "device_vendor", "device_product", "device_version", "event_id")
_CEF_KEY = r"[\w.\[\]]+"

ERRORS = {
    "regex": "no tokenize pattern matched",
    "json": "payload is not a JSON object",
    "kv": "no key=value pairs found",
    "csv": "too few columns",
    "cef": "truncated or missing CEF header",
    "leef": "truncated or missing LEEF header",
    "xml": "invalid XML",
}


# ---------------------------------------------------------------- regex
def regex_groups(p: str, pattern: str) -> str:
    """``groups`` of one pattern behind a cheap substring test."""
    px = port(pattern)
    got = groups(p, px.java, px.n_groups, px.anchored) if px.n_groups else (
        f"CASE WHEN {p} RLIKE {q(px.java)} THEN array('', '') ELSE array('') END")
    if len(px.literal) >= 3:
        return f"CASE WHEN contains({p}, {q(px.literal)}) THEN {got} ELSE array('') END"
    return got


def regex_matches(p: str, pattern: str) -> str:
    px = port(pattern)
    hit = f"{p} RLIKE {q(px.java)}"
    return f"(contains({p}, {q(px.literal)}) AND {hit})" if len(px.literal) >= 3 else f"({hit})"


def regex_entries(g: str, pattern: str) -> str:
    """Named groups as entries; ``g`` is the output of ``regex_groups``."""
    px = port(pattern)
    if not px.names:
        return f"CAST(array() AS {ENTRIES_TYPE})"
    items = [entry(q(n), f"nullif({g}[{i}], '')" if n in px.optional else f"{g}[{i}]") for n, i in px.names]
    arr = "array(" + ", ".join(items) + ")"
    return f"filter({arr}, e -> e.value IS NOT NULL)" if px.optional else arr


def patterns_of(spec: dict) -> list[dict]:
    """The pattern list of a regex definition as [{pattern, static}]."""
    raw = spec.get("patterns") or [spec["pattern"]]
    return [{"pattern": e, "static": {}} if isinstance(e, str)
            else {"pattern": e["pattern"], "static": e.get("static") or {}} for e in raw]


# ---------------------------------------------------------------- key=value
def kv_entries(p: str, pair_regex: str | None = None) -> str:
    if pair_regex:
        java = port(pair_regex).java
        pairs = (f"transform(regexp_extract_all({p}, {q(java)}, 0), m -> struct("
                 f"regexp_extract(m, {q(java)}, 1) AS key, regexp_extract(m, {q(java)}, 2) AS value))")
    else:
        pairs = (f"transform(regexp_extract_all({p}, {q(KV_PAIR)}, 0), m -> struct("
                 f"substring_index(m, '=', 1) AS key, substr(m, instr(m, '=') + 1) AS value))")
    return unquoted(pairs)


def unquoted(pairs: str) -> str:
    """Pairs without the quotes around their values; NULL when there are none."""
    quoted = ("length(e.value) >= 2 AND left(e.value, 1) = right(e.value, 1)"
              " AND left(e.value, 1) IN ('\"', '\\'')")
    bare = "replace(substr(e.value, 2, length(e.value) - 2), '\\\\\"', '\"')"
    return (f"nullif(transform({pairs}, e -> struct(e.key AS key,"
            f" CASE WHEN {quoted} THEN {bare} ELSE e.value END AS value)), CAST(array() AS {ENTRIES_TYPE}))")


# ---------------------------------------------------------------- csv
def delimiter_of(spec: dict) -> str:
    d = spec.get("delimiter", ",")
    return "\t" if d in ("\\t", "tab") else d


def csv_patterns(delimiter: str, quotechar: str) -> dict[str, str]:
    """The patterns of one separated layout: first record, one cell, a quoted cell, the separator alone."""
    d, qc = _rx(delimiter), _rx(quotechar)
    return {"record": f"^(?:[^{qc}\\r\\n]|{qc}(?:[^{qc}]|{qc}{qc})*+{qc}|{qc})*+",
            "cell": f"{d}({qc}(?:[^{qc}]|{qc}{qc})*+{qc}[^{d}]*|[^{d}]*)",
            "quoted": f"(?s)^{qc}((?:[^{qc}]|{qc}{qc})*+){qc}(.*)$", "separator": d}


def csv_cells(p: str, delimiter: str = ",", quotechar: str = '"') -> str:
    """Cells of the first record; quotes are honoured, the arity is kept."""
    return csv_cells_by(p, q(delimiter), q(quotechar), {k: q(v) for k, v in csv_patterns(delimiter, quotechar).items()})


def csv_cells_by(p: str, delimiter: str, quotechar: str, patterns: dict[str, str]) -> str:
    """The same with the layout in SQL texts, which may be columns."""
    line, quoted = strip(p), patterns["quoted"]
    record = f"regexp_extract({line}, {patterns['record']}, 0)"
    unquote = (f"CASE WHEN startswith(c, {quotechar}) AND instr(substr(c, 2), {quotechar}) > 0 THEN"
               f" concat(replace(regexp_extract(c, {quoted}, 1), concat({quotechar}, {quotechar}), {quotechar}),"
               f" regexp_extract(c, {quoted}, 2)) ELSE c END")
    slow = f"transform(regexp_extract_all(concat({delimiter}, {record}), {patterns['cell']}, 1), c -> {unquote})"
    fast = f"split(regexp_extract({line}, '^[^\\\\r\\\\n]*', 0), {patterns['separator']}, -1)"
    return f"CASE WHEN contains({p}, {quotechar}) THEN {slow} ELSE {fast} END"


def _rx(ch: str) -> str:
    return ch if ch.isalnum() or ch in "\t ,;:'\"" else "\\" + ch


def csv_names(spec: dict) -> list:
    return [None if n in (None, "_") else n for n in spec.get("fields") or []]


def csv_least(spec: dict) -> int:
    return int(spec.get("min_columns", len(csv_names(spec)) // 2 or 1))


def csv_entries(cells: str, spec: dict) -> str:
    """Entries from a cell array column (an attribute, referenced repeatedly)."""
    names = csv_names(spec)
    return csv_entries_by(cells, str_array(names), str(len(names)), str(csv_least(spec)))


def csv_entries_by(cells: str, names: str, n: str, least: str) -> str:
    """The same with names, their number and the least number of cells in SQL texts."""
    name = f"CASE WHEN i < {n} THEN get({names}, i) ELSE concat('_col', i) END"
    pairs = f"transform({cells}, (c, i) -> struct({name} AS key, c AS value))"
    return (f"CASE WHEN size({cells}) >= {least} AND NOT ({cells} = array('')) THEN"
            f" filter({pairs}, e -> e.key IS NOT NULL AND e.value <> '') END")


# ---------------------------------------------------------------- CEF
# a bar that is not escaped: not preceded by an odd run of backslashes
_BARE_BAR = r"(?<!(?<!\\)(?:\\\\){0,64}\\)\|"


def cef_cells(p: str) -> str:
    """Seven header cells and the extension (unescaped), or NULL without a header."""
    rest = f"substr({p}, instr({p}, 'CEF:') + 4)"
    exact = (f"transform(split({rest}, {q(_BARE_BAR)}, 8),"
             f" c -> regexp_replace(c, {q(chr(92) * 2 + '([|' + chr(92) * 2 + '])')}, '$1'))")
    return (f"CASE WHEN instr({p}, 'CEF:') > 0 THEN CASE WHEN contains({rest}, {q(chr(92))}) THEN {exact}"
            f" ELSE split({rest}, {q(chr(92) + '|')}, 8) END END")


def cef_entries(cells: str) -> str:
    header = "array(" + ", ".join(entry(q(n), strip(f"{cells}[{i}]")) for i, n in enumerate(CEF_HEADER)) + ")"
    ext = f"get({cells}, 7)"
    segments = f"split(trim({ext}), {q(r'\s+(?=' + _CEF_KEY + '=)')}, -1)"
    pair = r"(?s)^(?:.*[^\w.\[\]])?(" + _CEF_KEY + r")=(.*)$"
    pairs = (f"transform({segments}, s -> struct(regexp_extract(s, {q(pair)}, 1) AS key,"
             f" regexp_extract(s, {q(pair)}, 2) AS value))")
    # a value cannot hold an unescaped '='
    good = f"filter({pairs}, e -> e.key <> '' AND NOT e.value RLIKE {q(r'(^|[^' + chr(92) * 2 + r'])=')})"
    clean = strip(f"replace(replace(e.value, {q(chr(92) + '=')}, '='), {q(chr(92) + 'n')}, {q(chr(10))})")
    values = f"transform({good}, e -> struct(e.key AS key, {clean} AS value))"
    return (f"CASE WHEN size({cells}) >= 7 THEN CASE WHEN coalesce({ext}, '') = '' THEN {header}"
            f" ELSE concat({header}, {values}) END END")


# ---------------------------------------------------------------- LEEF
def leef_cells(p: str) -> str:
    """Header cells and the remainder; version 2 has a sixth cell, the delimiter."""
    body = f"substr({p}, instr({p}, 'LEEF:') + 5)"
    limit = f"CASE WHEN startswith({body}, '2') THEN 7 ELSE 6 END"
    return f"CASE WHEN instr({p}, 'LEEF:') > 0 THEN split({body}, '\\\\|', {limit}) END"


def leef_parts(cells: str) -> str:
    """STRUCT(head ARRAY, attrs STRING, delim STRING) from a cell column; NULL when truncated."""
    two = f"startswith({cells}[0], '2')"
    fifth, sixth = f"get({cells}, 4)", f"get({cells}, 5)"
    digits = f"regexp_replace(lower({sixth}), '^0*x*', '')"
    delim = (f"CASE WHEN NOT {two} THEN '\\t' WHEN lower({sixth}) RLIKE '^0?x[0-9a-f]+$'"
             f" THEN chr(CAST(conv({digits}, 16, 10) AS INT)) WHEN {sixth} <> '' THEN {sixth} ELSE '\\t' END")
    # version 1 may come without the bar after the event id
    late = f"NOT {two} AND size({cells}) = 5 AND contains({fifth}, '\\t')"
    return (f"CASE WHEN {cells} IS NULL OR size({cells}) < CASE WHEN {two} THEN 6 ELSE 5 END THEN NULL"
            f" WHEN {late} THEN struct(concat(slice({cells}, 1, 4), array(substring_index({fifth}, '\\t', 1)))"
            f" AS head, substr({fifth}, instr({fifth}, '\\t') + 1) AS attrs, '\\t' AS delim)"
            f" ELSE struct(slice({cells}, 1, 5) AS head,"
            f" coalesce(get({cells}, CASE WHEN {two} THEN 6 ELSE 5 END), '') AS attrs, {delim} AS delim) END")


def leef_entries(parts: str) -> str:
    header = "array(" + ", ".join(
        entry(q(n), strip(f"get({parts}.head, {i})")) for i, n in enumerate(LEEF_HEADER)) + ")"
    attrs = f"{parts}.attrs"
    pieces = f"split({attrs}, concat('\\\\Q', {parts}.delim, '\\\\E'), -1)"
    pairs = (f"transform(filter({pieces}, a -> contains(a, '=')), a -> struct("
             f"{strip('substring_index(a, ' + q('=') + ', 1)')} AS key,"
             f" {strip('substr(a, instr(a, ' + q('=') + ') + 1)')} AS value))")
    # attributes separated by spaces instead of tabs follow the key=value grammar
    spaced = (f"coalesce({kv_entries(attrs)}, CAST(array() AS {ENTRIES_TYPE}))")
    return (f"CASE WHEN {parts} IS NULL THEN NULL"
            f" WHEN {parts}.delim = '\\t' AND NOT contains({attrs}, '\\t') THEN"
            f" CASE WHEN contains({attrs}, '=') THEN concat({header}, {spaced}) ELSE {header} END"
            f" ELSE concat({header}, {pairs}) END")


# ---------------------------------------------------------------- JSON
def json_text(p: str) -> str:
    """From the first brace to the end, NULL when there is no brace."""
    return f"CASE WHEN instr({p}, '{{') > 0 THEN rtrim(substr({p}, instr({p}, '{{'))) END"


def json_variant(jtext: str) -> str:
    """VARIANT array of one object. Wrapping in [] makes trailing text an error, unless it closes the array itself:
    the parser stops there. Such a text doesn't close an object, so a text with brackets must parse in both."""
    return (f"CASE WHEN NOT contains({jtext}, ']') OR try_parse_json(concat('{{\"_\":', {jtext}, '}}')) IS NOT NULL"
            f" THEN try_parse_json(concat('[', {jtext}, ']')) END")


def json_repeated(jtext: str) -> str:
    """Token map of an object with repeated keys, which VARIANT refuses: the last one counts. NULL when it's no object."""
    return let({"x": json_walk(jtext)}, "w", last_wins_map("w.x"))


def json_object(v: str) -> str:
    """MAP<STRING,VARIANT> of the top level, NULL when it is not exactly one object."""
    return (f"CASE WHEN try_variant_get({v}, '$[1]', 'variant') IS NULL"
            f" THEN try_variant_get({v}, '$[0]', 'map<string,variant>') END")


_JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]++'
#: What VARIANT would spell anew: fractions, exponents, and integers that a BIGINT may not hold.
#: Also arrays with objects or escapes in them: VARIANT sorts keys.
#: An array without any, nor arrays in it, is passed over, whatever follows it.
_OTHER_SPELLING = r'[:\[,]\s*-?\d+(?:[.eE]|\d{17})|\[(?!(?:[^\[\]{}"\\]|"[^"\\]*+")*+\])[\s\S]*[{\\]'


def json_walk(jtext: str) -> str:
    """Entries of one object of any depth, with repeated keys, each number as it was written; NULL when it isn't
    exactly one object.

    One pass over the structural tokens keeps the path of open objects. A repeated key takes away what was found
    under it; arrays are one value, their text without blanks. Keys are parted by U+0001 until the end, so that a
    key which holds dots stays apart from a path.
    """
    sep = "'\\u0001'"
    valid = (f"coalesce(size(from_json(concat('[', {jtext}, ']'), 'array<map<string,string>>')), 0) = 1"
             f" AND from_json(concat('[', {jtext}, ']'), 'array<map<string,string>>')[0] IS NOT NULL")
    tokens = f"regexp_extract_all({jtext}, {q(_JSON_TOKEN)}, 0)"
    text = ("CASE WHEN NOT startswith(t, '\"') THEN t WHEN contains(t, '\\\\') THEN from_json(concat('[', t, ']'), 'array<string>')[0]"
            " ELSE substr(t, 2, length(t) - 2) END")
    at = f"concat_ws({sep}, s.path, s.key)"
    emit = "concat(s.out, array(struct({k} AS key, {v} AS value)))"

    def state(path="s.path", key="s.key", depth="s.depth", buf="s.buf", fresh="false", level="s.level", more="s.more", out="s.out"):
        return (f"named_struct('path', {path}, 'key', {key}, 'depth', {depth}, 'buf', {buf}, 'fresh', {fresh}, 'level', {level}, 'more', {more},"
                f" 'out', {out})")

    none = "CAST(NULL AS STRING)"
    step = "CAST(CASE WHEN t IN ('[', '{{') THEN 1 WHEN t IN (']', '}}') THEN -1 ELSE 0 END AS INT)".format()
    inside = (f"CASE WHEN s.depth + {step} = 0 THEN " + state(key=none, depth="0", buf="''", out=emit.format(k=at, v="concat(s.buf, t)"))
              + " ELSE " + state(depth=f"s.depth + {step}", buf="concat(s.buf, t)") + " END")
    named = f"concat_ws({sep}, s.path, k)"
    again = f"filter(s.out, e -> e.key <> {named} AND NOT startswith(e.key, concat({named}, {sep})))"
    as_key = (f"element_at(transform(array({text}), k -> " + state(
        key="k", out=f"CASE WHEN exists(s.out, e -> e.key = {named} OR startswith(e.key, concat({named}, {sep}))) THEN {again} ELSE s.out END") + "), 1)")
    opened = state(path="CASE WHEN s.key IS NULL THEN s.path ELSE concat(s.path, array(s.key)) END", key=none, fresh="true", level="s.level + 1")
    closed = state(level="CASE WHEN s.level = 1 THEN -1 ELSE s.level - 1 END", path="slice(s.path, 1, greatest(size(s.path) - 1, 0))", out="CASE WHEN s.fresh AND size(s.path) > 0 THEN "
                   + emit.format(k=f"array_join(s.path, {sep})", v="'{}'") + " ELSE s.out END")
    value = state(key=none, out=emit.format(k=at, v=f"CASE WHEN t = 'null' THEN {none} ELSE {text} END"))
    # the parser that tells whether the text is valid ignores what follows the end of the wrapping array
    merge = (f"CASE WHEN s.level < 0 THEN {state(more='true')} WHEN s.depth > 0 THEN {inside} WHEN t = '{{' THEN {opened} WHEN t = '}}' THEN {closed}"
             f" WHEN t = '[' THEN {state(depth='1', buf=repr('['))} WHEN t IN (':', ',') THEN {state()}"
             f" WHEN s.key IS NULL THEN {as_key} ELSE {value} END")
    start = ("named_struct('path', CAST(array() AS ARRAY<STRING>), 'key', CAST(NULL AS STRING), 'depth', 0, 'buf', '', 'fresh', false, 'level', 0, 'more', false,"
             f" 'out', CAST(array() AS {ENTRIES_TYPE}))")
    walked = f"aggregate({tokens}, {start}, (s, t) -> {merge}, s -> CASE WHEN NOT s.more THEN s.out END)"
    # a flat key that holds dots beats the nested path: it comes last
    parted = f"concat(filter(o, e -> contains(e.key, {sep})), filter(o, e -> NOT contains(e.key, {sep})))"
    dotted = f"transform({parted}, e -> struct(replace(e.key, {sep}, '.') AS key, e.value AS value))"
    return f"CASE WHEN {valid} THEN element_at(transform(array({walked}), o -> {dotted}), 1) END"


def json_entries(v: str, jtext: str, depth: int = JSON_DEPTH) -> str:
    """Dotted entries; a flat key that holds dots beats the nested path (it comes last).

    Most documents are flat enough for expressions over VARIANT; those with more objects than ``depth``, with repeated
    keys, or with numbers or arrays that VARIANT would spell anew are walked token by token. Both ways give the same
    entries where both apply.
    """
    obj = "try_variant_get({x}, '$', 'map<string,variant>')"

    def level(var_map: str, k: int) -> str:
        e = f"e{k}"
        sub = f"s{k}"
        if k == depth:
            inner = f"array(struct({e}.key AS key, CAST({e}.value AS STRING) AS value))"
        else:
            nested = level(f"{sub}.m", k + 1)
            inner = (
                f"element_at(transform(array(struct({obj.format(x=e + '.value')} AS m)), {sub} ->"
                f" CASE WHEN {sub}.m IS NULL OR size({sub}.m) = 0 THEN"
                f" array(struct({e}.key AS key, CAST({e}.value AS STRING) AS value))"
                f" ELSE transform({nested}, x{k} -> struct(concat({e}.key, '.', x{k}.key) AS key,"
                f" x{k}.value AS value)) END), 1)"
            )
        return f"flatten(transform(map_entries({var_map}), {e} -> {inner}))"

    flat = level("o.m", 1)
    ordered = "concat(filter(f, e -> contains(e.key, '.') AND NOT map_contains_key(o.m, e.key))," \
              " filter(f, e -> NOT contains(e.key, '.') OR map_contains_key(o.m, e.key)))"
    top = json_object(v)
    variant_route = (
        f"element_at(transform(array(struct({top} AS m)), o -> CASE WHEN o.m IS NOT NULL THEN"
        f" element_at(transform(array({flat}), f -> CASE WHEN exists(f, e -> contains(e.key, '.'))"
        f" THEN {ordered} ELSE f END), 1) END), 1)"
    )
    objects = f"replace({jtext}, '{{}}', '')"  # an empty object is a value at any depth
    braces = f"length({objects}) - length(replace({objects}, '{{', '')) > {depth}"
    return (f"CASE WHEN {jtext} IS NULL THEN NULL WHEN {v} IS NULL OR {braces} OR {jtext} RLIKE {q(_OTHER_SPELLING)}"
            f" THEN {json_walk(jtext)} ELSE {variant_route} END")


# ---------------------------------------------------------------- XML
def _xml_tokens(text: str | None) -> list[tuple[str, str]] | None:
    """Tokens of one document from its stream of start and end events: only the open elements are held, so
    depth costs no recursion and finished parts are freed. None if it isn't well formed."""
    if text is None:
        return None
    local = lambda name: name.rpartition("}")[2]
    parser = ET.XMLPullParser(("start", "end"))
    found: list[tuple[int, str, str]] = []  # place of the element in the document, key, value
    open_: list[tuple[int, str]] = []
    try:
        parser.feed(text[max(text.find("<"), 0):])
        parser.close()
        for place, (event, element) in enumerate(parser.read_events()):
            if event == "start":
                path = ".".join([*(p for _, p in open_[-1:]), local(element.tag)])
                open_.append((place, path))
                found += [(place, f"{path}@{local(a)}", v) for a, v in element.attrib.items() if a != "Name"]
                continue
            place, path = open_.pop()
            value, label = (element.text or "").strip(), element.attrib.get("Name")
            if value and (label is not None or not len(element)):
                found.append((place, path if label is None else label, value))
    except (ET.ParseError, ValueError):
        return None
    found.sort(key=lambda entry: entry[0])
    return list({key: value for _, key, value in found}.items())


def _xml_batches(payload: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in payload:
        yield batch.map(lambda t: None if (got := _xml_tokens(t)) is None
                        else [{"key": k, "value": v} for k, v in got])


def xml_entries(payload: Column) -> Column:
    """Entries of an XML payload, in Arrow batches: arbitrary element paths are
    outside what Catalyst's xpath functions express."""
    return F.pandas_udf(_xml_batches, ENTRIES_TYPE)(payload)


# ---------------------------------------------------------------- table operators
def _with_map(df: DataFrame, entries_sql: str, out: str) -> DataFrame:
    keep = [f"`{c}`" for c in df.columns]
    staged = df.selectExpr(*keep, f"{entries_sql} AS _entries")
    return staged.selectExpr(*keep, f"{last_wins_map('_entries')} AS `{out}`")


def tokenize_regex(df: DataFrame, patterns, col: str = "payload", out: str = "tokens") -> DataFrame:
    """First matching pattern's named groups; ``variant`` is its position (NULL = no match)."""
    pats = patterns_of({"patterns": list(patterns)})
    keep = [f"`{c}`" for c in df.columns]
    p = f"`{col}`"
    variant = case([(regex_matches(p, e["pattern"]), str(i)) for i, e in enumerate(pats)])
    df = df.selectExpr(*keep, f"CAST({variant} AS INT) AS variant")
    g = case([(f"variant = {i}", regex_groups(p, e["pattern"])) for i, e in enumerate(pats)])
    df = df.selectExpr(*keep, "variant", f"{g} AS _g")
    entries = case([(f"variant = {i}", regex_entries("_g", e["pattern"])) for i, e in enumerate(pats)], NO_ENTRIES)
    df = df.selectExpr(*keep, "variant", f"{entries} AS _entries")
    return df.selectExpr(*keep, "variant", f"{last_wins_map('_entries')} AS `{out}`")


def tokenize_kv(df: DataFrame, col: str = "payload", out: str = "tokens", pair_regex: str | None = None) -> DataFrame:
    return _with_map(df, kv_entries(f"`{col}`", pair_regex), out)


def tokenize_csv(df: DataFrame, fields, delimiter: str = ",", quotechar: str = '"', min_columns: int | None = None,
                 col: str = "payload", out: str = "tokens") -> DataFrame:
    spec = {"fields": list(fields)}
    if min_columns is not None:
        spec["min_columns"] = min_columns
    keep = [f"`{c}`" for c in df.columns]
    staged = df.selectExpr(*keep, f"{csv_cells(f'`{col}`', delimiter, quotechar)} AS _cells")
    staged = staged.selectExpr(*keep, f"{csv_entries('_cells', spec)} AS _entries")
    return staged.selectExpr(*keep, f"{last_wins_map('_entries')} AS `{out}`")


def tokenize_cef(df: DataFrame, col: str = "payload", out: str = "tokens") -> DataFrame:
    keep = [f"`{c}`" for c in df.columns]
    staged = df.selectExpr(*keep, f"{cef_cells(f'`{col}`')} AS _cells")
    staged = staged.selectExpr(*keep, f"{cef_entries('_cells')} AS _entries")
    return staged.selectExpr(*keep, f"{last_wins_map('_entries')} AS `{out}`")


def tokenize_leef(df: DataFrame, col: str = "payload", out: str = "tokens") -> DataFrame:
    keep = [f"`{c}`" for c in df.columns]
    staged = df.selectExpr(*keep, f"{leef_cells(f'`{col}`')} AS _cells")
    staged = staged.selectExpr(*keep, f"{leef_parts('_cells')} AS _parts")
    staged = staged.selectExpr(*keep, f"{leef_entries('_parts')} AS _entries")
    return staged.selectExpr(*keep, f"{last_wins_map('_entries')} AS `{out}`")


def tokenize_json(df: DataFrame, col: str = "payload", out: str = "tokens") -> DataFrame:
    """One strict object per payload -> dotted keys, of any depth."""
    keep = [f"`{c}`" for c in df.columns]
    staged = df.selectExpr(*keep, f"{json_text(f'`{col}`')} AS _jtext")
    staged = staged.selectExpr(*keep, "_jtext", f"{json_variant('_jtext')} AS _v")
    staged = staged.selectExpr(*keep, f"{json_entries('_v', '_jtext')} AS _entries")
    return staged.selectExpr(*keep, f"{last_wins_map('_entries')} AS `{out}`")


def tokenize_xml(df: DataFrame, col: str = "payload", out: str = "tokens") -> DataFrame:
    keep = [f"`{c}`" for c in df.columns]
    staged = df.select("*", xml_entries(F.col(col)).alias("_entries"))
    return staged.selectExpr(*keep, f"{last_wins_map('_entries')} AS `{out}`")
