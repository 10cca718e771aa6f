"""Bytes as they were sent, ids that tell equal lines apart."""

from logloom.sources.ingest import explode_batches, mint_ids, read_batch_json


def test_batch_bodies_keep_what_was_sent(spark, tmp_path):
    sent = ['{"z":1,"a":2.50}', "[1.0, 1e5, 123456789012345678901234567890123456789012]", "17.0", "true"]
    body = '{"events": [' + ", ".join(f'{{"raw": {x}}}' for x in sent) + ', {"raw": "a \\"q\\" \u00e9"}, {"raw": null}, {"channel": "x"}]}'
    (tmp_path / "b.json").write_text(body)
    good, bad = read_batch_json(spark, str(tmp_path))
    got = [bytes(r["raw"]).decode() for r in good.orderBy("event_no").collect()]
    assert got == [*sent, 'a "q" \u00e9']
    assert [(r["channel"], r["error"]) for r in bad.orderBy("event_no").collect()] == [
        ("http", "missing 'raw' field"), ("x", "missing 'raw' field")]
    kept = explode_batches(spark.createDataFrame([(body,)], "body string")).filter("event_no IN (0, 4)").orderBy("event_no")
    assert [bytes(r["raw"]).decode() for r in kept.collect()] == ['{"z":1,"a":2.5}', 'a "q" \u00e9']
    assert explode_batches(spark.createDataFrame([(None,), ("",), ("{",)], "body string")).count() == 0


def test_equal_lines_have_ids_of_their_own(spark):
    rows = [("f1", "x")] * 3 + [("f1", "y"), ("f2", "x")]
    df = spark.createDataFrame(rows, "file string, line string").selectExpr("file", "CAST(line AS BINARY) AS raw", "'c' AS channel")
    ids = lambda n: sorted(r["event_id"] for r in mint_ids(df.repartition(n), "file", number_equal=True).collect())
    assert len(set(ids(1))) == 5 and ids(1) == ids(4)
    assert set(r["event_id"] for r in mint_ids(df, "file").collect()) < set(ids(2))
