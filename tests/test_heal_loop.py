"""From proposals to rollback: score, promote, replay with a failed attempt in between, withdraw."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import heal, publish
from logloom.plans import interpreted as ip
from logloom.plans.registry import Registry
from logloom.schema import event_schema
from logloom.sources.ingest import mint_ids

from .test_golden import GOLDEN, U

GOOD = {"source_id": "zz", "version": "v1", "fingerprint": {"type": "contains", "pattern": "app=zz"}, "tokenize": {"type": "kv"}, "ocsf": {"class_uid": 4001},
        "mapping": {"fields": {"ip": "src_endpoint.ip"}}}
GREEDY = {**GOOD, "source_id": "gr", "channels": [U], "priority": 99, "fingerprint": {"type": "contains", "pattern": "="},
          "mapping": {"fields": {"ip": "src_endpoint.ip", "src": "src_endpoint.ip"}}}
LINES = ["app=zz ip=10.0.0.1", "app=zz ip=10.0.0.2", "app=zz ip=10.0.0.2", "app=zz nothing", "app=zz ip=10.0.0.9 " + "x" * 5000]
STATUS = "event_id STRING, cluster_id STRING, status STRING, at TIMESTAMP"


@pytest.fixture(scope="module")
def raw(spark):
    rows = spark.createDataFrame([(i, t, U) for i, t in enumerate(LINES)], "n INT, text STRING, channel STRING").selectExpr(
        "*", "CAST(text AS BINARY) AS raw", "CAST(NULL AS STRING) AS source_hint", "timestamp'2024-01-03 10:22:05' AS ingest_time")
    return mint_ids(rows, "n").cache()


@pytest.fixture(scope="module")
def pending(raw):
    return raw.selectExpr("event_id", "channel", "source_hint", "left(text, 4000) AS raw_snippet", "'no_parser_match' AS reason", "CAST(NULL AS STRING) AS parser_id",
                          "'c1' AS cluster_id", "raw_ref", "sha256 AS raw_sha256", "ingest_time", "ingest_time AS ts", "'pending' AS status")


def test_loop(spark, raw, pending, tmp_path):
    store, base = publish.Store(spark, f"file://{tmp_path}/store"), Registry.load()
    corpus = spark.createDataFrame([("pf", 1, GOLDEN[0][1])], "file STRING, line_no INT, text STRING").withColumn("ingest_time", F.expr("timestamp'2024-01-03 10:22:05'"))
    exp = spark.createDataFrame([("pf", "pfsense", U, 4001)], "file STRING, source_id STRING, channel STRING, class_uid INT")
    cands = spark.createDataFrame([("c1", "good", 0, json.dumps(GOOD)), ("c1", "greedy", 1, json.dumps(GREEDY))], "cluster_id STRING, candidate STRING, position INT, definition STRING")
    scores = heal.score(cands, raw.withColumn("cluster_id", F.lit("c1")), ip.live_definitions(spark, base), corpus, exp).withColumn("status", F.lit("open")).cache()
    assert heal.best_candidate(scores).first()["candidate"] == "good"

    # the gate
    assert publish.promote(store, base, scores.filter("candidate = 'greedy'"), json.dumps(GREEDY)) == {"refused": "regression corpus failed"}
    assert publish.promote(store, base, scores.filter("candidate = 'none'"), "{}")["refused"]
    assert publish.registry_log(store).count() == 0 and publish.current_registry(store, base) is base
    assert publish.promote(store, base, scores.filter("candidate = 'good'"), json.dumps(GOOD)) == {"source_id": "zz", "version": "v1", "seq": 1}
    again = publish.promote(store, base, scores.filter("candidate = 'good'"), json.dumps({**GOOD, "log_name": "second"}))
    assert again == {"source_id": "zz", "version": "v2", "seq": 2}
    live = publish.current_registry(store, base)
    assert (live.get("zz")["version"], live.get("zz")["log_name"]) == ("v2", "second") and len(live.parsers) == len(base.parsers) + 1

    # a replay that dies after its tables are written, but before its manifest
    archive = raw.filter("n <> 1 AND n <> 4").select("event_id", "raw")
    real = store.create
    store.create = lambda path, text: (_ for _ in ()).throw(RuntimeError("lost")) if path.startswith("_manifest") else real(path, text)
    with pytest.raises(RuntimeError):
        publish.replay(store, "r1", pending, archive, live, "2024-01-04 00:00:00")
    store.create = real
    assert store.read("events", event_schema()).count() == 0 and store.read("status", STATUS).count() == 0
    # again, twice
    for _ in range(2):
        summary = publish.replay(store, "r1", pending, archive, live, "2024-01-04 00:00:00").collect()
        assert [tuple(r) for r in summary] == [("c1", 5, 3, 1, 1)]
    events, status = store.read("events", event_schema()), store.read("status", STATUS)
    assert events.count() == 3 and events.select("metadata.uid").distinct().count() == 3
    assert {r[0] for r in events.select("metadata.parser.version").collect()} == {"v2"}
    assert sorted(r["event_id"] for r in status.collect()) == sorted(r[0] for r in events.select("metadata.uid").collect())
    from logloom.operators import dlq
    assert dlq.pending(pending, status).count() == 2

    # back to the version before, then to none
    publish.rollback(store, "zz")
    assert publish.current_registry(store, base).get("zz")["version"] == "v1"
    publish.rollback(store, "zz")
    assert publish.current_registry(store, base).get("zz") is None
    assert publish.registry_log(store).count() == 4


def test_one_number_goes_to_one_promotion(spark, tmp_path):
    a, b = (publish.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    seen = b.names
    assert publish.append(a, "x", "v1", "promote", "{}") == 1
    listed = [[]]  # b has listed the folder before a wrote
    b.names = lambda p: listed.pop() if listed and p.startswith("_registry/") else seen(p)
    assert publish.append(b, "x", "v1", "promote", "{}") == 2
    with pytest.raises(ValueError):
        publish.append(a, "../x", "v1", "promote", "{}")
