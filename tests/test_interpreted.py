"""Definitions as data against the compiled parser set, and candidates against corpus and samples."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import heal, regression
from logloom.plans import interpreted as ip
from logloom.plans.pipeline import parse_flat
from logloom.plans.registry import Registry

from .test_golden import BAD, GOLDEN, U

COLUMNS = ["'11111111-1111-4111-8111-111111111111' AS event_id", "repeat('a', 64) AS sha256", "'local://t/x' AS raw_ref", "1L AS size_bytes",
           "timestamp'2024-01-03 10:22:05' AS ingest_time"]
ODD = [(U, None), (U, ""), (U, "a\x01b filterlog"), (None, "date=2024-01-03 srcip=1.2.3.4"), (U, "x" * 30000 + " filterlog"),
       (U, '{"event_type":"alert","alert":{},"src_ip":"nope"}'), (U, "CEF:0|a|b"), ("http", '{"a.b":1,"a":{"b":2},"event_type":"flow"}')]


def _lines(spark):
    rows = [(i, c, t) for i, (c, t) in enumerate([*[(c, t) for c, t, _ in GOLDEN], *[(U, t) for t, _, _ in BAD], *ODD])]
    return spark.createDataFrame(rows, "n INT, channel STRING, text STRING").selectExpr("*", *COLUMNS)


def test_interpreted_claims_equal_the_compiled_set(spark):
    registry = Registry.load()
    live = ip.with_rules(ip.live_definitions(spark, registry).withColumnRenamed("source_id", "definition_id"))
    assert live.filter("rules.problem IS NOT NULL").count() == 0
    won = ip.claims(_lines(spark), live, ["n"], block=3).filter("ok").groupBy("n").agg(F.min_by(F.struct("source_id", "class_uid"), F.struct(
        ~F.col("prefers"), -F.col("priority"))).alias("b"))
    got = {r["n"]: tuple(r["b"]) for r in won.collect()}
    flat = parse_flat(_lines(spark), registry).filter("reason IS NULL").select("n", "metadata__source_id", "class_uid")
    assert got == {r[0]: (r[1], r[2]) for r in flat.collect()} and len(got) >= len(GOLDEN)


TEST_SET = [
    {"source_id": "kvs", "fingerprint": {"type": "any", "rules": [{"type": "regex", "pattern": r"(?i)^K=\d"}, {"type": "startswith", "pattern": "k=y"}]},
     "tokenize": {"type": "kv", "pair_regex": r"(\w+)=(\S+)"}, "ocsf": {"class_uid": 4001, "static": {"src_endpoint.ip": "10.0.0.1"}},
     "mapping": {"fields": {"a": "dst_endpoint.ip", "b": "dst_endpoint.ip"}, "values": {"b": {"X": "10.0.0.9"}}}},
    {"source_id": "csvs", "fingerprint": {"type": "contains", "pattern": "|"}, "tokenize": {"type": "csv", "delimiter": "|", "fields": ["p", "_", "q"], "min_columns": 3},
     "mapping": {"fields": {"q": ["src_endpoint.ip"]}, "lookups": [{"from": "p", "to": "class_uid", "map": {"net": 4001}, "default": 0}]}},
    {"source_id": "rx", "fingerprint": {"type": "all", "rules": [{"type": "contains", "pattern": "rx"}, {"type": "contains", "pattern": "from"}]},
     "tokenize": {"type": "regex", "patterns": [r"rx (?P<w>\d+) from (?P<s>\S+)(?: to (?P<t>\S+))?", {"pattern": r"rx from (?P<s>\S+)", "static": {"class_uid": 4001}}]},
     "ocsf": {"class_uid": 0}, "mapping": {"fields": {"w": "class_uid", "ip": "src_endpoint.ip", "t": "dst_endpoint.ip"},
                                           "extract": [{"from": "s", "pattern": r"^(?P<ip>[\d.]+):(?P<port>\d+)$"}]}},
    {"source_id": "js", "fingerprint": {"type": "json_key", "key": "a.b"}, "tokenize": {"type": "json"}, "mapping": {"fields": {"a.ip": "src_endpoint.ip"}}},
    {"source_id": "xm", "fingerprint": {"type": "contains", "pattern": "<E"}, "tokenize": {"type": "xml"}, "mapping": {"fields": {"E.ip": "src_endpoint.ip"}}},
]
TEXTS = ["k=1 b=x", "K=2 a=10.0.0.7 b=", "k=yes", "k=1 b=bad", "net|1|10.0.0.3", "other|1|-", "a|b", '"net"|"x|y"|nope', "rx 4001 from 10.0.0.1:5 to 10.0.0.2",
         "rx from 10.0.0.1:5", "rx 4001 from host", "rx from host", "rx word from a", '{"a":{"b":1,"ip":"1.2.3.4"}}', '{"a":{"b":null}}', '{"a":{"b":{"c":1}}}',
         "<E><ip>9.9.9.9</ip></E>", "<E><ip>bad</ip></E>", "<E>"]


def test_one_definition_at_a_time_equals_the_compiled_one(spark):
    rows = spark.createDataFrame([(i, U, t) for i, t in enumerate(TEXTS)], "n INT, channel STRING, text STRING").selectExpr("*", *COLUMNS)
    frame = spark.createDataFrame([(d["source_id"], json.dumps(d)) for d in TEST_SET], "definition_id STRING, definition STRING")
    got = {(r["n"], r["definition_id"]): (r["reason"], r["class_uid"]) for r in ip.claims(rows, ip.with_rules(frame), ["n"]).collect()}
    want = {}
    for d in TEST_SET:
        for r in parse_flat(rows, Registry.of([d])).select("n", "reason", "class_uid").collect():
            if r["reason"] != "no_parser_match":
                want[r["n"], d["source_id"]] = (r["reason"], r["class_uid"])
    assert got == want and len(want) >= 17


@pytest.mark.parametrize("text", [None, "", "[]", "a: [", "{}", '{"source_id":"x","fingerprint":{"type":"regex","pattern":"("},"tokenize":{"type":"kv"},"mapping":{}}',
                                  '{"source_id":"x","fingerprint":{"type":"contains","pattern":"a"},"tokenize":{"type":"regex","pattern":"(a)?(?(1)b|c)"},"mapping":{}}'])
def test_definitions_that_cannot_be_used_say_why(text):
    assert ip.rules_of(text)["problem"]


def test_scores_of_many_candidates_in_one_job(spark):
    line = lambda k, t: (k, U, t)
    corpus = spark.createDataFrame([("pf", 1, GOLDEN[0][1]), ("pf", 2, GOLDEN[1][1]), ("sq", 1, GOLDEN[2][1]), ("bad", 1, BAD[0][0]), ("bad", 2, BAD[1][0])],
                                   "file STRING, line_no INT, text STRING").withColumn("ingest_time", F.expr("timestamp'2024-01-03 10:22:05'"))
    exp = spark.createDataFrame([("pf", "pfsense", U, 4001), ("sq", "squid", "file:squid", None), ("bad", None, U, None)],
                                "file STRING, source_id STRING, channel STRING, class_uid INT")
    registry = Registry.load()
    live = ip.live_definitions(spark, registry)
    base = {"fingerprint": {"type": "contains", "pattern": "app=zz"}, "tokenize": {"type": "kv"}, "ocsf": {"class_uid": 4001},
            "mapping": {"fields": {"ip": "src_endpoint.ip"}}, "priority": 55}
    docs = {"c1:good": {**base, "source_id": "zz"}, "c1:greedy": {**base, "source_id": "gr", "priority": 99, "channels": [U], "mapping": {"fields": {"src": "src_endpoint.ip"}}, "fingerprint": {"type": "contains", "pattern": "filterlog"}},
            "c1:broken": {"source_id": "br"}, "c2:replaces": {**base, "source_id": "pfsense"}, "c2:nothing": {**base, "source_id": "no", "tokenize": {"type": "csv"}}}
    cands = spark.createDataFrame([(n[:2], n, i, json.dumps(d)) for i, (n, d) in enumerate(docs.items())], "cluster_id STRING, candidate STRING, position INT, definition STRING")
    samples = spark.createDataFrame([line("c1", "app=zz ip=10.0.0.1"), line("c1", "app=zz ip=bad"), line("c1", "other"), line("c2", "app=zz ip=10.0.0.1 q")],
                                    "cluster_id STRING, channel STRING, text STRING").selectExpr("*", *COLUMNS)
    scores = heal.score(cands, samples, live, corpus, exp).cache()
    got = {r["candidate"]: r for r in scores.collect()}
    assert set(got) == set(docs)
    assert (got["c1:good"]["parsed"], got["c1:good"]["total"], got["c1:good"]["match_rate"]) == (1, 3, 0.333)
    assert sorted(e[:2] for e in got["c1:good"]["errors"]) == ["1x", "1x"] and got["c1:good"]["regression_passed"]
    assert not got["c1:broken"]["valid_config"] and got["c1:broken"]["error"] and got["c1:broken"]["parsed"] == 0
    for name, doc in docs.items():  # as the compiled set with the candidate in it
        if name != "c1:broken":
            want = regression.gate(regression.check(corpus, exp, registry.overlay(doc))).first()
            assert (got[name]["regression_total"], got[name]["regression_failed"], got[name]["regression_passed"]) == tuple(want), name
    assert got["c1:greedy"]["regression_failed"] > 0 and got["c2:replaces"]["regression_failed"] == 2
    best = {r["cluster_id"]: r["candidate"] for r in heal.best_candidate(scores).collect()}
    assert best == {"c1": "c1:good", "c2": "c2:nothing"}
    _, failing = regression.check_candidates(ip.with_rules(cands).filter("rules.problem IS NULL"), ip.with_rules(live), corpus, exp)
    assert {(r["file"], r["line_no"]) for r in failing.filter("candidate = 'c2:replaces'").collect()} == {("pf", 1), ("pf", 2)}


def test_lines_are_judged_in_as_many_tasks_as_their_number_asks(spark):
    """Few bytes may be much work: the optimizer must not put the tries of all lines into one task."""
    lines = spark.range(4000).selectExpr("id AS n", "concat('kind=a id=', id) AS text", "'udp:5514' AS channel", "current_timestamp() AS ingest_time")
    doc = {"source_id": "a", "fingerprint": {"type": "contains", "pattern": "kind=a"}, "tokenize": {"type": "kv"}, "mapping": {"fields": {"id": "message"}}}
    live = ip.with_rules(spark.createDataFrame([("a", json.dumps(doc))], "definition_id STRING, definition STRING"))
    got = ip.claims(lines, live, ["n"], rows=500).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) < 2000
