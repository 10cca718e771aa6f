"""Rows are dealt by their number, not by the bytes of their files; a sort parses its input once."""

from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.operators import sinks
from logloom.schema import event_schema
from logloom.sources import ingest


def test_narrow_table_is_dealt_over_tasks(spark, tmp_path):
    n = 120_000
    spark.range(n).selectExpr("id AS event_id", "1L AS user_id", "'view' AS event_type", "1D AS value", "timestamp'2024-01-01 00:00:00' AS ts").coalesce(
        1).write.parquet(str(tmp_path / "events.parquet"))
    table = spark.read.parquet(str(tmp_path / "events.parquet"))
    assert fx.base(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    dealt = ingest.spread(table, "event_id", rows=10_000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * n / 12
    assert dealt.agg(F.count("*"), F.countDistinct("event_id")).first()[:] == (n, n)


def test_feature_table_computes_its_events_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(i):
        seen.add(1)
        return i

    n = 500
    once = F.udf(count, "bigint")
    cols = [once("id").alias(f.name) if f.name == "time" else F.lit(None).cast(f.dataType).alias(f.name) for f in event_schema().fields]
    rows = sinks.feature_table(spark.range(0, n, 1, 4).select(*cols)).collect()
    assert [r["time_ms"] for r in rows] == list(range(n))
    assert seen.value == n


def test_deframe_fills_batches_over_streams(spark):
    blobs = spark.createDataFrame([(i, b"3 abcx\r\n%d rest\n" % i if i % 2 else b"") for i in range(200)], "path INT, content BINARY")
    got = ingest.deframe_syslog(blobs.coalesce(1)).orderBy("path", "frame_no").collect()
    want = [(i, k, bytes(m)) for i in range(200) if i % 2 for k, m in enumerate(ingest.frames(b"3 abcx\r\n%d rest\n" % i))]
    assert [(r["path"], r["frame_no"], bytes(r["raw"])) for r in got] == want


def test_deframe_makes_few_frames_of_rows(spark):
    rows = [(i, b"a\n") for i in range(30)]
    made = list(ingest.unframed(iter(rows), most=10))
    assert [len(b) for b in made] == [10, 10, 10] and made[0][0] == (0, 0, b"a")
