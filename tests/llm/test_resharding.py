"""Resharded tables as they lie in files: no row is lost or doubled, and shards nobody touches keep their files."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from logloom.llm import sharding

SCHEMA = "doc_id long, text string, lang string"


def _reshard(spark, layout, files, shards, path):
    """Reshards a table whose files hold shard, or (``layout`` empty) one row in three in each old shard."""
    source = sharding.keyed(files)
    old = F.col("shard") if layout else F.col("doc_id") % 3
    rows = source.select("doc_id", "text", *sharding.ROW, old.cast("int").alias("at"))
    rows = sharding.sized(rows).drop("text").withColumn("old_shard", F.coalesce("at", F.lit(0))).drop("at")
    new = sharding.rewrite(source, sharding.placed(rows, shards), layout, path)
    return new, sharding.stored(spark, new, files.schema)


def _whole(got, want, shards):
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in got) == want
    for n in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == n) == list(range(sum(r["shard"] == n for r in got)))
    assert {r["shard"] for r in got} <= set(range(shards))


def test_rewrite_loses_and_doubles_no_row(spark, tmp_path):
    data = [(i, "x" * (i % 50 + 1), "en") for i in range(300)] + [(7, "same", None)] * 5 + [(None, None, "de"), (None, "", None)]
    spark.createDataFrame(data, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/t")
    want = Counter(data)
    layout, table = _reshard(spark, {}, spark.read.parquet(f"{tmp_path}/t"), 5, str(tmp_path))
    _whole(table.collect(), want, 5)
    # fewer shards: those that give everything away have no folder; a second call (a retry) gives the same rows
    for _ in range(2):
        less, again = _reshard(spark, layout, table, 2, str(tmp_path))
        assert set(less) == {0, 1} and not set(less.values()) & set(layout.values())
        _whole(again.collect(), want, 2)
    # the same number of shards: rows of a middle that a cut meets may move, untouched shards keep their folder
    same, third = _reshard(spark, less, again, 2, str(tmp_path))
    _whole(third.collect(), want, 2)
    assert spark.read.parquet(f"{tmp_path}/t").count() == len(data)


def test_untouched_shards_keep_their_folder(spark, tmp_path):
    spark.createDataFrame([(i, "x" * 8, "en") for i in range(12)], SCHEMA).write.parquet(f"{tmp_path}/t")
    layout, table = _reshard(spark, {}, spark.read.parquet(f"{tmp_path}/t"), 3, str(tmp_path))
    assert set(layout) == {0, 1, 2}
    same, again = _reshard(spark, layout, table, 3, str(tmp_path))
    assert same == layout
    _whole(again.collect(), Counter((i, "x" * 8, "en") for i in range(12)), 3)


def test_op10_reads_its_rows_back_from_the_shards(spark, tmp_path, monkeypatch):
    data = [(i, "word " * (i % 20), "en") for i in range(100)] + [(5, "twice", None)] * 2 + [(None, None, None)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    layouts = []
    kept = sharding.rewrite
    monkeypatch.setattr(sharding, "rewrite", lambda *a: layouts.append(kept(*a)) or layouts[-1])
    got = sharding.op10_resharding(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data)
    lies = spark.read.parquet(*layouts[0].values())
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in lies.collect()) == Counter(data)
    assert sorted((r["shard"], r["slot"]) for r in lies.collect()) == sorted((r["shard"], r["slot"]) for r in got)


def test_equal_texts_part_only_at_cuts(spark):
    """Many texts of one size whose CRCs fall into one bin: only a text that a cut meets lies in two shards."""
    texts, i = [], 0
    while len(texts) < 40:
        t = f"{i:08d}"
        if zlib.crc32(t.encode()) % 4096 == 7:
            texts.append(t)
        i += 1
    rows = spark.createDataFrame([(20 * n + k, t) for n, t in enumerate(texts) for k in range(20)], "doc_id long, text string")
    got = sharding.reshard(rows, F.lit(0), 5).collect()
    lies = {t: {r["shard"] for r in got if r["text"] == t} for t in texts}
    assert sum(len(s) - 1 for s in lies.values()) <= 4
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1


def test_names_of_working_columns_pass_through(spark):
    rows = spark.createDataFrame([(i, "t" * i, 1, "s", 2, 3) for i in range(9)],
                                 "doc_id long, text string, start int, one string, b0 int, _part int")
    got = sharding.reshard(rows, F.lit(0), 2).collect()
    assert {(r["start"], r["one"], r["b0"], r["_part"]) for r in got} == {(1, "s", 2, 3)} and len(got) == 9


def test_flow_is_cheapest():
    """Bytes that move at least: what an old shard holds beyond its own new capacity (others must move at any rate)."""
    rng = random.Random(4)
    for _ in range(200):
        old = {o: rng.randrange(30) for o in range(rng.randrange(1, 6))}
        new = sharding.capacities(sum(old.values()), rng.randrange(1, 7))
        flow = sharding.min_cost_flow(old, new)
        for o, amount in old.items():
            assert sum(x for (a, _), x in flow.items() if a == o) == amount
        assert all(sum(x for (_, b), x in flow.items() if b == n) == c for n, c in new.items())
        assert sum(x for (a, b), x in flow.items() if a != b) == sum(max(x - new.get(o, 0), 0) for o, x in old.items())


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id AS doc_id", "repeat(CAST(id AS STRING), 9) AS text", "'en' AS lang").write.parquet(str(tmp_path / "in"))
    source = sharding.keyed(spark.read.parquet(str(tmp_path / "in")))
    rows = sharding.sized(source).select("doc_id", *sharding.ROW, "size", "text_crc32", (F.col("doc_id") % 3).cast("int").alias("old_shard"),
                                         (F.col("doc_id") % 5).alias("shard"), F.floor(F.col("doc_id") / 5).alias("slot"))
    plans = []
    writer = type(source.write)
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **k))[1])
    layout = sharding.rewrite(source, rows, {}, str(tmp_path))
    (plan,) = [p for p in plans if "Join" in p]
    assert "REPARTITION" not in plan  # nothing is shuffled after the join
    got = sharding.stored(spark, layout, source.schema).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == [(i, i % 5, i // 5) for i in range(300)]
