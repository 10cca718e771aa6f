"""What a table's size at the plan hides: rows that a map makes many of."""

import numpy as np


def test_queries_dealt_to_their_leaves_are_never_broadcast(spark, monkeypatch):
    from logloom.llm import ann
    monkeypatch.setattr(ann, "LEAF", 16)
    x = np.random.default_rng(3).normal(size=(600, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = ann.Index(rows).search(rows.filter("id % 20 = 0"), 20)
    assert len(found.collect()) == 30 * 20
    plan = found._jdf.queryExecution().executedPlan().toString()  # as it ran, after Spark has seen the sizes
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _copies(spark, n=120, seed=4):
    """Documents that share passages, and the bytes that each loses, by brute force."""
    from logloom.llm.suffix_dedup import WIDTH
    rng = np.random.default_rng(seed)
    word = lambda: bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8))
    shared = [b" ".join(word() for _ in range(40)) for _ in range(6)]
    texts = [b" ".join(x for _ in range(3) for x in (shared[rng.integers(6)][rng.integers(20):], word(), word())) for _ in range(n)]
    seen, lost = set(), {}
    for i, text in enumerate(texts):
        own = {text[a:a + WIDTH] for a in range(len(text) - WIDTH + 1)}
        gone = np.zeros(len(text), bool)
        for a in range(len(text) - WIDTH + 1):
            if text[a:a + WIDTH] in seen:
                gone[a:a + WIDTH] = True
        seen |= own
        lost[i] = (int(gone.sum()), bytes(np.frombuffer(text, np.uint8)[~gone]))
    return spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3), lost


def test_shuffle_files_go_with_their_stage(spark):
    import time

    from pyspark.sql import functions as F

    from logloom.llm import suffix_dedup
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString(" ").split() if f.endswith(".data")}
    docs, _ = _copies(spark)
    before = files()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    suffix_dedup.removals(docs.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("crc"), "text"))
    for _ in range(50):  # files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_bitmap_grows_with_what_repeats_and_nothing_is_missed(spark, monkeypatch):
    from logloom.llm import suffix_dedup
    docs, lost = _copies(spark)
    sizes = {}
    for least, most in ((10, 10), (10, 22), (18, 18)):
        monkeypatch.setattr(suffix_dedup, "FILTER_BITS", least)
        monkeypatch.setattr(suffix_dedup, "FILTER_MOST", most)
        bitmap, _, _ = suffix_dedup.repeated_keys(docs, 4)
        sizes[least, most] = 8 * len(bitmap), float(np.unpackbits(bitmap).mean())
    assert sizes[10, 10][0] == 1 << 10 and sizes[10, 22][1] < 0.2 < sizes[10, 10][1]
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", 8)  # ranges with few repeats have fewer bits than others
    monkeypatch.setattr(suffix_dedup, "FILTER_MOST", 20)
    monkeypatch.setattr(suffix_dedup, "HELD", 300)
    monkeypatch.setattr(suffix_dedup, "SOLVED", 7)
    monkeypatch.setattr(suffix_dedup, "MOST_BUCKETS", 5)
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.deduplicate(docs).collect()}
    assert got == lost and sum(n for n, _ in lost.values()) > 10_000


def test_packed_segments_come_back(spark):
    from logloom.llm import suffix_dedup as sd
    rng = np.random.default_rng(2)
    n = 2000
    doc = rng.choice(np.array([sd.NULL_ID, -5, 0, 7, (1 << 63) - 1, 123456789012]), n)
    crc, start = rng.integers(0, 1 << 32, 3)[rng.integers(0, 3, n)], rng.integers(0, 1 << 20, n)
    size, key = sd.WIDTH + rng.integers(0, 400, n), rng.integers(0, 1 << 63, n).astype(np.uint64)
    blob = rng.integers(97, 101, int(size.sum())).astype(np.uint8)
    rows = lambda k, d, c, s, z, b: sorted(zip((k & np.uint64(0xFFFFFFFF)).tolist(), d.tolist(), c.tolist(), s.tolist(), z.tolist(), (
        bytes(x) for x in np.split(b, np.cumsum(z)[:-1])), strict=True))
    packed = sd._packed(key, doc, crc, start, size, blob)
    assert rows(*(x.astype(np.uint64) if i == 0 else x for i, x in enumerate(sd._unpacked(packed)))) == rows(key, doc, crc, start, size, blob)
    # texts apart, a segment takes its 4 bytes of key and little more
    assert len(sd._packed(key, doc, crc, start, size, np.zeros_like(blob))) < 11 * n
    whole = sd._content(blob, size)
    assert (np.concatenate([sd._content(x, np.array([len(x)])) for x in np.split(blob, np.cumsum(size)[:-1])]) == whole).all()
