"""Queries that do their whole job again: whole streams, candidates of every user."""

from logloom.queries import inference, parsing
from logloom.sources import ingest


def _events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr(
        "*", "1D AS value", "timestamp'2024-01-01 00:00:00' AS ts").repartition(3).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_user_has_one_whole_stream(spark, tmp_path, monkeypatch):
    folder = _events(spark, tmp_path, [(i, i % 5 + 1, "view") for i in range(600)])
    seen, deframe = [], ingest.deframe_syslog
    monkeypatch.setattr(ingest, "deframe_syslog", lambda df, *a: seen.append(df) or deframe(df, *a))
    got = {r["user_id"]: (r["messages"], r["bytes"]) for r in parsing.QUERIES["src_deframe"](spark, folder).collect()}
    line = lambda user: b"###UNKNOWN### code=%d x~~y" % user
    assert got == {u: (120, 120 * len(line(u))) for u in range(1, 6)}
    blobs = [(r["user_id"], bytes(r["content"])) for r in seen[0].collect()]
    assert sorted(blobs) == [(u, b"".join(b"%d %s" % (len(line(u)), line(u)) if i // 12 % 2 == 0 else line(u) + b"\r\n" for i in range(
        600) if i % 5 + 1 == u).rstrip(b"\r\n")) for u in range(1, 6)]
    assert any(b.endswith(b"\n" + line(u)) for u, b in blobs)  # a rest that nothing ends


def test_candidates_of_every_user_are_ranked(spark, tmp_path, monkeypatch):
    kinds = ["view", "click", "signup", "purchase", "error"]
    rows = [(i, i * i % 7, kinds[i * i * i % 11 % 5]) for i in range(400)] + [(i, None, "signup") for i in range(400, 404)]
    folder = _events(spark, tmp_path, rows)
    real = spark.createDataFrame([("c1", "c1:a", True, True, 0.5, 2, 1), ("c1", "c1:b", True, True, 0.5, 2, 0)],
                                 "cluster_id string, candidate string, valid_config boolean, regression_passed boolean, match_rate double, mapped_fields int, position int")
    monkeypatch.setattr(inference, "scores", lambda *_: real)
    got = {(r["cluster_id"], r["user_id"], r["candidate"]) for r in inference.QUERIES["heal_best_candidate"](spark, folder).collect()}
    best = {}
    for i, user, kind in rows:
        best.setdefault(user, {}).setdefault(kind, []).append(i)
    want = {(None, u, max(of, key=lambda t: (t != "signup", len(of[t]) % 2 == 0, len(of[t]) % 10, len(of[t]) % 4, -min(of[t])))) for u, of in best.items()}
    assert got == want | {("c1", None, "c1:b")} and len(want) > 3
