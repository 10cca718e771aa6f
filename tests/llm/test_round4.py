"""Figures that grow with the table: rows between steps, workers of a task, shuffles."""

import numpy as np


def test_one_worker_encodes_and_decodes(spark, tmp_path):
    from logloom.llm import bpe
    rows = [(1, "ab é  cd"), (2, None), (3, "x" * 50), (4, ""), (5, "a<|endoftext|>b"), (5, "日本 \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.encode(df, decoded="decoded").select("doc_id", "text", "ids", "decoded").collect()
    assert sorted(got, key=str) == sorted(bpe.decode(bpe.encode(df)).select("doc_id", "text", "ids", "decoded").collect(), key=str)
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plan = bpe.op5_bpe(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_task_sends_k_neighbours_of_a_query(spark):
    from logloom.llm import ann
    rng, k = np.random.default_rng(3), 5
    x = rng.integers(-3, 4, (600, 4)).astype(float)  # many ties
    asked = np.arange(0, 600, 20)
    block = lambda at: (at.astype(np.int64).tobytes(), x[at].tobytes())
    query = lambda at, floor=-np.inf: (at.astype(np.int64).tobytes(), np.hstack([x[at], np.full((len(at), 1), floor)]).tobytes())
    rows = [(5, *query(part), *block(c), leaf) for part in np.split(asked, 2) for leaf, c in enumerate(np.split(np.arange(600), 40))]
    pairs = spark.createDataFrame(rows, "dim int, q_ids binary, q_data binary, c_ids binary, c_data binary, leaf int").coalesce(1)
    found = ann._nearest(pairs, k)
    assert found.count() == len(asked) * k  # not k from each of the 40 blocks
    got = {}
    for r in ann._ranked(found, k).orderBy("query_id", "rank").collect():
        assert r["leaf"] == r["vec_id"] // 15
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for i in asked:
        scores = x @ x[i]
        assert got[i] == [(j, scores[j]) for j in np.lexsort((np.arange(600), -scores)) if j != i][:k]
    few = spark.createDataFrame([(5, *query(asked[:2]), *block(np.arange(3)), 0)], pairs.schema)
    assert ann._nearest(few, k).count() == 2 + 3
    none = spark.createDataFrame([(5, *query(asked, 1000.0), *block(np.arange(600)), 0)], pairs.schema)
    assert ann._nearest(none, k).count() == 0


def test_floors_leave_the_found_neighbours(spark, monkeypatch):
    from logloom.llm import ann
    monkeypatch.setattr(ann, "SAMPLE", 300)  # the index has rows beyond its sample
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (1500, 5)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    index = ann.Index(rows)
    asked = rows.filter("id % 50 = 0")
    with_floor = index.search(asked, 20).orderBy("query_id", "rank").collect()
    index._sample = spark.sparkContext.broadcast((np.zeros(0, int), np.zeros(0, int), np.zeros((0, 5))))
    assert with_floor == index.search(asked, 20).orderBy("query_id", "rank").collect() and len(with_floor) == 30 * 20


def test_join_stage_keeps_each_row_once_and_shuffles_texts_once(spark):
    import corpus_pipeline
    rows = [(1, "a b c d e f"), (1, " \n"), (2, "x y z q r s"), (2, "x y z q r s"), (None, "k l m n o p"), (None, ""), (3, "a b c d e f"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
            [rows[0], rows[1], rows[2], rows[4], rows[5], rows[7]], key=str)
        plan = corpus_pipeline.near_duplicates(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 2  # documents and the ids that stay
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
