"""Single operators on small edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions.regexes import port
from logloom.operators import sinks, tokenizers as tk
from logloom.operators.dlq import last_k, latest
from logloom.operators.envelope import parse_envelope
from logloom.plans.registry import Registry, check_definition
from logloom.sources.ingest import frames, read_datagrams


def one(spark, text, fn, **kw):
    df = spark.createDataFrame([(text,)], "payload STRING")
    return fn(df, **kw).collect()[0]["tokens"]


def test_cef_escapes(spark):
    t = one(spark, r"CEF:0|Ven\|dor|P\\q|1|100|Name|5|msg=a\=b c spt=1 cs1=x y path=C:\\x bad=a=b", tk.tokenize_cef)
    assert t["device_vendor"] == "Ven|dor" and t["device_product"] == "P\\q" and t["msg"] == "a=b c" and t["cs1"] == "x y"
    assert t["path"] == "C:\\x" and "bad" not in t and t["a"] == "b"


def test_kv_quotes_and_repeats(spark):
    t = one(spark, "a=1 b=\"x \\\"y\\\" z\" c='q r' a=2;d=e,f", tk.tokenize_kv)
    assert t == {"a": "2", "b": 'x "y" z', "c": "q r", "d": "e"}
    assert one(spark, "nothing here", tk.tokenize_kv) is None


def test_long_quoted_value_does_not_exhaust_the_stack(spark):
    long = 'x\\"' * 100_000
    assert len(one(spark, f'k="{long}" z=1', tk.tokenize_kv)["k"]) == 200_000


def test_csv_quotes(spark):
    assert one(spark, '1,"x,y",3', tk.tokenize_csv, fields=["a", "_", "c"]) == {"a": "1", "c": "3"}
    assert one(spark, '"a ""b""",,z,more', tk.tokenize_csv, fields=["a", "b", "c"]) == {"a": 'a "b"', "c": "z", "_col3": "more"}
    assert one(spark, "x", tk.tokenize_csv, fields=["a", "b", "c", "d"]) is None


@pytest.mark.parametrize("text,want", [
    ('noise {"a":1,"b":{"c":"x"},"l":[1]}', {"a": "1", "b.c": "x", "l": "[1]"}),
    ('{"a":1} trailing', None), ('{"a":1},{"b":2}', None), ("[1]", None),
    ('{"a":1,"a":2}', {"a": "2"}), ('{"a":"{\\"not\\":1}"}', {"a": '{"not":1}'}),
])
def test_json_is_strict(spark, text, want):
    assert one(spark, text, tk.tokenize_json) == want


def test_leef_forms(spark):
    t = one(spark, "LEEF:2.0|V|P|1|E|x5e|a=1^b=x=y", tk.tokenize_leef)
    assert (t["a"], t["b"]) == ("1", "x=y")
    assert one(spark, "LEEF:2.0|V|P", tk.tokenize_leef) is None


def test_xml_paths(spark):
    t = one(spark, '<e xmlns="u"><s id="4">v</s><Data Name="Ip">10.0.0.1</Data></e>', tk.tokenize_xml)
    assert t == {"e.s@id": "4", "e.s": "v", "Ip": "10.0.0.1"}
    assert one(spark, "<broken", tk.tokenize_xml) is None


def test_regex_with_separator_in_text(spark):
    df = spark.createDataFrame([("k=\x01v end",)], "payload STRING")
    row = tk.tokenize_regex(df, [r"k=(?P<v>\S+) (?P<e>\w+)(?P<o>!)?"]).collect()[0]
    assert row["tokens"] == {"v": "\x01v", "e": "end"} and row["variant"] == 0


def test_regex_port():
    px = port(r"(?P<a_b>x)?[[&]y(?P<z>q{2})")
    assert dict(px.names) == {"a_b": 1, "z": 2} and px.optional == {"a_b"} and "?P<" not in px.java


def test_envelopes(spark):
    rows = [('<165>1 2024-01-03T10:22:01.003Z fw01 app 123 ID47 [ex@1 iut="3"] hello world',),
            ("<134>Jan  3 10:22:01 host01 sshd[42]: Failed password",), ('{"a": 1}',), ("<14>plain",)]
    df = spark.createDataFrame(rows, "text STRING").withColumn("ingest_time", F.lit("2024-01-04").cast("timestamp"))
    a, b, c, d = parse_envelope(df).collect()
    assert (a.envelope.format, a.envelope.hostname, a.envelope.syslog_severity, a.payload) == ("rfc5424", "fw01", 5, "hello world")
    assert (b.envelope.app_name, b.envelope.procid, b.envelope.time) == ("sshd", "42", "2024-01-03T10:22:01+00:00")
    assert c.envelope is None and c.payload == '{"a": 1}' and (d.envelope.format, d.payload) == ("pri_only", "plain")


def test_frames():
    assert list(frames(b"5 hello3 abc")) == [b"hello", b"abc"]
    assert list(frames(b"one\r\n\n7 a\nb\ncd\ntwo")) == [b"one", b"a\nb\ncd", b"two"]
    assert list(frames(b"99 short")) == [b"99 short"]


def test_datagrams_keep_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\xff\xfe x\r\n\x00\n"),)], "packet BINARY")
    assert bytes(read_datagrams(df).collect()[0]["raw"]) == b"\x00\xff\xfe x"


def test_registry_keeps_the_good_ones():
    good = {"source_id": "a", "fingerprint": {"type": "contains", "pattern": "x"}, "tokenize": {"type": "kv"}, "mapping": {}}
    reg = Registry.of([good, {"source_id": "b"}, {**good, "source_id": "c", "tokenize": {"type": "nope"}}])
    assert reg.source_ids() == ["a"] and [n for n, _ in reg.errors] == ["b", "c"]
    assert check_definition({**good, "fingerprint": {"type": "regex", "pattern": "("}})


def test_latest_and_last_k(spark):
    df = spark.createDataFrame([("a", i, i * i) for i in range(10)] + [("b", 3, 1)], "k STRING, id INT, v INT")
    assert {r["k"]: r["v"] for r in latest(df, "k", "id").collect()} == {"a": 81, "b": 1}
    assert last_k(df, "k", "id", 3).count() == 4


def test_fan_out_isolates_failures(spark):
    seen = []

    def bad(_):
        raise ValueError("no")

    out = sinks.fan_out(spark.range(3), {"bad": bad, "good": lambda d: seen.append(d.count())})
    assert out == {"bad": "no", "good": None} and seen == [3]


def test_proposed_definitions_parse_their_samples(spark):
    """Every inferred definition is valid and parses all of the lines it came from."""
    from logloom.plans.pipeline import route
    from logloom.queries.inference import heal_propose, samples

    sf = "/root/testdata/sf0.001"
    rows = heal_propose(spark, sf).collect()
    assert len(rows) == 4
    s = samples(spark, sf).drop("event_id").selectExpr(
        "cluster_id AS cl", "text", "channel", "ingest_time", "'11111111-1111-4111-8111-111111111111' AS event_id",
        "repeat('a', 64) AS sha256", "'local://t/x' AS raw_ref")
    for r in rows:
        doc = json.loads(r["definition"])
        assert check_definition(doc) is None, r
        assert r["mapped_fields"] >= 3
        out = route(s.filter(F.col("cl") == r["cluster_id"]), Registry.of([doc]))
        assert out.filter("reason IS NOT NULL").count() == 0, (r["cluster_id"], doc)
