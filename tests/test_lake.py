"""What is written can be read back: lines, lake, flat tables, archive; what a stream wrote is pruned by source."""

import re

from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.operators import archive, enrich, sinks
from logloom.plans.registry import Registry
from logloom.sources.ingest import read_lines, read_normalized, stream_lines
from logloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_stream_writes_the_lake_that_read_normalized_prunes(spark, tmp_path):
    reg = Registry.load().only("fortigate", "pfsense")
    fx.lines(spark, SF, 0, 6, 11).select("text").repartition(2).write.text(f"{tmp_path}/in")
    lines = read_lines(spark, f"{tmp_path}/in", "udp:5514")
    paths = dict(events_path=f"{tmp_path}/ev", dlq_path=f"{tmp_path}/dlq", checkpoint=f"{tmp_path}/cp", archive_path=f"{tmp_path}/ar",
                 changes_path=f"{tmp_path}/ch")
    jobs.parse_stream(stream_lines(spark, f"{tmp_path}/in", "udp:5514"), reg, **paths).awaitTermination()
    whole = read_normalized(spark, f"{tmp_path}/ev")
    sources = {r["source_id"]: r["count"] for r in whole.groupBy("source_id").count().collect()}
    assert set(sources) == {"fortigate", "pfsense"}
    one = read_normalized(spark, f"{tmp_path}/ev", source="pfsense")
    assert one.count() == sources["pfsense"] and {r[0] for r in one.select("metadata.source_id").distinct().collect()} == {"pfsense"}
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[[^]\n]*source_id", plan)
    day = whole.select("day").first()["day"]
    assert read_normalized(spark, f"{tmp_path}/ev", day=day).filter(~F.col("time_dt").startswith(day)).count() == 0
    # the archive holds every line, and the changes count the quarantine
    kept = archive.read_archive(spark, f"{tmp_path}/ar")
    assert kept.count() == lines.count() and archive.verify(kept).filter("NOT verified").count() == 0
    dlq = spark.read.parquet(f"{tmp_path}/dlq")
    assert spark.read.parquet(f"{tmp_path}/ch").agg(F.sum("change")).first()[0] == dlq.count() > 0

    # the same events as JSON lines, as Parquet and flat
    events = whole.drop("source_id", "day", "batch").persist()
    sinks.write_jsonl(events, f"{tmp_path}/json")
    sinks.write_parquet(events, f"{tmp_path}/pq")
    sinks.write_flat(events, f"{tmp_path}/flat")
    want = {tuple(r) for r in events.select("metadata.uid", "time_dt", "src_endpoint.ip", "raw_data" if "raw_data" in events.columns else "class_uid").collect()}
    for fmt, path in (("json", "json"), ("parquet", "pq")):
        back = read_normalized(spark, f"{tmp_path}/{path}", fmt=fmt)
        assert {tuple(r) for r in back.select("metadata.uid", "time_dt", "src_endpoint.ip", "raw_data" if "raw_data" in events.columns else "class_uid").collect()} == want
    flat = spark.read.parquet(f"{tmp_path}/flat")
    assert {r[0] for r in flat.select("`metadata.uid`").collect()} == {r[0] for r in want} and flat.count() == events.count()
    events.unpersist()


def test_networks_of_any_prefix_length(spark):
    import ipaddress
    nets = ["10.0.0.0/8", "10.1.2.3/31", "0.0.0.0/0", "192.0.2.7", "::/0", "2001:db8::/29", "2001:db8:5:ff::/63", "2001:db8::1", "2001:db8::1/127", "x/8", "10.0.0.0/99", None]
    ips = ["10.1.2.2", "10.1.2.4", "192.0.2.7", "2001:db8::1", "2001:db8::", "2001:db8:5:fe::9", "2001:db8:5:fd::9", "2001:dbf::", "fe80::1", "nothing", None]
    bounds = enrich.network_bounds(spark.createDataFrame([(n,) for n in nets + nets[:2]], "cidr string"))
    got = enrich.join_cidrs(spark.createDataFrame([(i,) for i in ips], "ip string"), "ip", bounds).collect()
    want = []
    for i in ips[:-2]:
        for n in nets[:9]:
            net, a = ipaddress.ip_network(n, strict=False), ipaddress.ip_address(i)
            if net.version == a.version and a in net:
                want.append((i, n))
    assert sorted((r["ip"], r["cidr"]) for r in got) == sorted(want)
