"""Operator 4: exact top-k inner products, norm-sorted, over SVD-rotated vectors.

All vectors are sorted by descending length and packed into blocks of neighbours in that order. The rotation
comes from the eigenvectors of the sum of outer products over all vectors (the right singular vectors of the
whole table), so that the leading coordinates carry most of every product. A query meets the blocks in two
waves. The longest vectors come first and give it a score to beat. After that a block is skipped where
|q| * |longest of the block| can't beat it (Cauchy-Schwarz), and inside a block a vector is dropped where the
partial sum over the leading coordinates plus |rest of q| * |rest of x| can't. What is left is scored on the
exact integers, so rounding in the rotation (allowed for by a margin) never decides.

Queries are a stated set and travel in blocks too; a pair of blocks is one unit of work, so a common vector
or a large query set splits evenly. Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; rows that repeat an id count as candidates each, but never for a query of that id; a query row that repeats is asked once;
vectors of another dimension aren't compared; an empty table gives no rows; fewer candidates than k give all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table
from .vectors import as_block, best, packed, usable

SCALE, BLOCK, QUERY_BLOCK = 1024, 2048, 512


def rotation(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the eigenvectors of the Gram matrix, largest first. A task sends a matrix of dim x dim,
    whatever its rows."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = as_block(row)[1]
                sums[row["dim"]] = sums.get(row["dim"], 0) + x.T @ x
        for d, g in sums.items():
            i = np.arange(d * d, dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(d * d, d, np.int32)), "cell": pa.array(i), "x": g.ravel()})

    found = blocks.select("dim", "ids", "data").mapInArrow(run, "dim int, cell int, x double").groupBy("dim", "cell").agg(
        F.sum("x").alias("x")).toPandas()
    out = {}
    for d, part in found.groupby("dim"):
        gram = part.sort_values("cell")["x"].to_numpy().reshape(d, d)
        out[int(d)] = np.linalg.eigh(gram)[1][:, ::-1]
    return out


def _search(pairs: DataFrame, turn: dict[int, np.ndarray], k: int) -> DataFrame:
    """The k best of every pair of blocks (q_* and c_*, with the scores to beat): query_id, vec_id, score."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                qi, q = as_block({"ids": row["q_ids"], "data": row["q_data"], "dim": row["dim"]})
                ci, c = as_block({"ids": row["c_ids"], "data": row["c_data"], "dim": row["dim"]})
                beat = np.frombuffer(row["beat"], np.float64) if row["beat"] else np.full(len(qi), -np.inf)
                v = turn[row["dim"]]
                lead = max(1, row["dim"] // 4)
                qr, cr = q @ v, c @ v
                q_rest, c_rest = (np.sqrt((x[:, lead:] ** 2).sum(axis=1)) for x in (qr, cr))
                margin = 1e-9 * np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1)) + 1e-6
                bound = qr[:, :lead] @ cr[:, :lead].T + q_rest[:, None] * c_rest + margin
                out = []
                for i in range(len(qi)):
                    some = np.flatnonzero(bound[i] >= beat[i])
                    some = some[ci[some] != qi[i]]
                    if not len(some):
                        continue
                    order = some[np.argsort(-bound[i, some])]
                    # the most promising first: their exact scores raise the score to beat for the others
                    head = order[:4 * k]
                    scores = c[head] @ q[i]
                    if len(order) > len(head):
                        least = max(np.partition(scores, len(scores) - k)[len(scores) - k], beat[i])
                        more = order[4 * k:][bound[i, order[4 * k:]] >= least]
                        head, scores = np.concatenate([head, more]), np.concatenate([scores, c[more] @ q[i]])
                    top = best(ci[head], scores, k)
                    out.append((np.full(len(top), qi[i]), ci[head][top], scores[top].astype(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                                                     ["query_id", "vec_id", "score"])

    return pairs.select("dim", "q_ids", "q_data", "c_ids", "c_data", "beat").mapInArrow(
        run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, first: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates (id, v) of every query (id, v); components
    are integers held as doubles. ``first``: blocks of the first wave."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sorted_ = candidates.withColumn("len", length).repartitionByRange(F.desc("len"), "id").sortWithinPartitions(F.desc("len"), "id")
    blocks = saved(packed(sorted_, BLOCK).withColumn("c_block", F.monotonically_increasing_id()))
    # a query row that repeats is asked once
    asked = saved(packed(queries.distinct(), QUERY_BLOCK).withColumn("q_block", F.monotonically_increasing_id()))
    turn = rotation(blocks)
    c = blocks.select("dim", "c_block", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"), F.col("longest").alias("c_len"))
    q = asked.select("dim", "q_block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("longest").alias("q_len"))
    # the longest blocks, by a sort of a row per block
    head = blocks.orderBy(F.desc("longest"), "c_block").limit(first).select("c_block").withColumn("first", F.lit(True))
    # pairs of block names with their lengths; the matrices join after what can be skipped is gone
    names = (q.select("dim", "q_block", "q_len").join(c.select("dim", "c_block", "c_len"), "dim")
             .join(F.broadcast(head), "c_block", "left"))

    def pairs(chosen: DataFrame) -> DataFrame:
        return chosen.join(q.drop("dim", "q_len"), "q_block").join(c.drop("dim", "c_len"), "c_block")

    wave = saved(_search(pairs(names.filter("first").withColumn("beat", F.lit(None).cast("binary"))), turn, k))
    least = _ranked(wave, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(
        F.lit(None)).cast("double").alias("beat"))

    def to_arrays(batches):
        """The scores to beat of a query block, in the order of its ids."""
        for batch in batches:
            blocks_, beats_, lows = [], [], []
            for r in batch.to_pylist():
                known = {x["query_id"]: x["beat"] for x in r["found"] or []}
                x = np.array([known.get(i, -np.inf) for i in np.frombuffer(r["q_ids"], np.int64).tolist()])
                blocks_.append(r["q_block"])
                beats_.append(x.tobytes())
                lows.append(float(x.min()))
            yield pa.RecordBatch.from_pydict({"q_block": pa.array(blocks_, pa.int64()), "beat": pa.array(beats_, pa.binary()),
                                              "least": pa.array(lows, pa.float64())})

    def to_ids(batches):
        for batch in batches:
            for block, ids in zip(batch.column("q_block").to_pylist(), batch.column("q_ids"), strict=True):
                i = np.frombuffer(ids.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block)), pa.array(i)], ["q_block", "query_id"])

    home = q.select("q_block", "q_ids").mapInArrow(to_ids, "q_block long, query_id long").distinct()
    found = home.join(least.filter("beat is not null"), "query_id").groupBy("q_block").agg(
        F.collect_list(F.struct("query_id", "beat")).alias("found"))  # QUERY_BLOCK entries at most
    beats = saved(q.select("q_block", "q_ids").join(found, "q_block", "left").mapInArrow(
        to_arrays, "q_block long, beat binary, least double"))
    rest = names.filter("first is null").join(beats, "q_block").filter("q_len * c_len * (1 + 1e-9) >= least")
    return _ranked(wave.unionByName(_search(pairs(rest), turn, k)), k).select("query_id", F.col("rank").cast("int").alias(
        "rank"), "vec_id", "score")


def quantized(df: DataFrame) -> DataFrame:
    return df.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v")).filter("id is not null")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    rows = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter("id % 100 = 0"))


QUERIES = {"op4_topk": op4_topk}
ORACLES: dict[str, str] = {}
