"""Stream equals batch, restarts add nothing, a failing extra sink stops nobody."""

from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.plans.pipeline import route
from logloom.plans.registry import Registry
from logloom.sources.ingest import stream_lines
from logloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_parse_stream_matches_batch(spark, tmp_path):
    reg = Registry.load().only("fortigate", "pfsense")
    lines = fx.lines(spark, SF, 6, 11).select("text")
    lines.repartition(2).write.text(str(tmp_path / "in"))
    src = stream_lines(spark, str(tmp_path / "in"), "udp:5514")
    paths = dict(events_path=str(tmp_path / "ev"), dlq_path=str(tmp_path / "dlq"), checkpoint=str(tmp_path / "cp"))

    def broken(_):
        raise RuntimeError("sink down")

    told = []
    for _ in range(2):  # the second run finds nothing new
        jobs.parse_stream(src, reg, extra={"siem": broken}, row_key="concat(file, ':', sha256)",
                          report=lambda n, errors: told.append((n, *errors)), **paths).awaitTermination()
    assert told == [(0, "siem")]
    batch = route(lines.selectExpr("CAST(text AS BINARY) AS raw", "'udp:5514' AS channel", "timestamp'2024-02-01' AS ingest_time",
                                   "'11111111-1111-4111-8111-111111111111' AS event_id", "repeat('a', 64) AS sha256",
                                   "'local://t/x' AS raw_ref"), reg)
    want = {r["source_id"]: r["count"] for r in batch.groupBy("source_id").count().collect()}
    events = spark.read.parquet(str(tmp_path / "ev")).groupBy(F.col("metadata.source_id").alias("s")).count().collect()
    assert {r["s"]: r["count"] for r in events} == {"fortigate": want["fortigate"]}
    assert spark.read.parquet(str(tmp_path / "dlq")).count() == want[None]


def test_throughput_and_dedup(spark, tmp_path):
    rows = fx.base(spark, SF).selectExpr("eid", "CAST(eid % 500 AS STRING) AS event_id", "timestamp_seconds(eid) AS ts",
                                         "CASE WHEN eid % 3 = 0 THEN 'x' END AS reason")
    rows.write.parquet(str(tmp_path / "rows"))
    schema = spark.read.parquet(str(tmp_path / "rows")).schema
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "rows"))
    for name, df in (("tp", jobs.throughput(src, bucket="100 seconds")), ("dd", jobs.dedup(src))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option(
            "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    got = {r["t"].timestamp(): r["ingested"] for r in spark.table("tp").collect()}
    assert got and set(got.values()) == {100}
    assert spark.table("dd").count() == 500
