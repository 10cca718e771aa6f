from pyspark.sql import functions as F

from logloom.operators import metrics


def _rows(spark, seconds):
    return spark.createDataFrame([(s, None if s % 3 else "x", s % 2 == 0) for s in seconds], "s INT, reason STRING, replayed BOOLEAN").selectExpr(
        "timestamp'2024-01-03 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s) AS ts", "reason", "replayed")


def test_history_fills_gaps_and_rates_look_back(spark):
    seconds = [0, 0, 1, 5, 5, 5, 13]
    hist = metrics.history(_rows(spark, seconds), last=None)
    got = [(r["ingested"], r["dlq"]) for r in hist.orderBy("t").collect()]
    assert got == [(seconds.count(i), seconds.count(i) if i % 3 == 0 else 0) for i in range(14)]
    rates = metrics.events_per_bucket(hist, 10).orderBy("t").collect()
    for i, r in enumerate(rates):
        before = [seconds.count(j) for j in range(max(0, i - 10), i)]
        assert (r["last_sum"], r["last_n"]) == (sum(before), len(before))
    assert metrics.history(_rows(spark, seconds), last=4).count() == 4
    assert metrics.history(_rows(spark, [])).count() == 0


def test_totals_count_replayed_lines_where_told(spark):
    row = metrics.totals(_rows(spark, [0, 1, 2, 3])).first()
    assert (row["total_ingested"], row["total_parsed"], row["total_dlq"], row["total_replayed"]) == (4, 2, 2, 2)
    assert "total_replayed" not in metrics.totals(_rows(spark, [1]).select("reason", F.col("ts"))).columns
