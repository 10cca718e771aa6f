"""Vectors in blocks: the rows of a vector table packed into matrices that move and multiply as wholes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = "block long, n int, dim int, longest double, ids binary, data binary"


def usable(vector: Column) -> Column:
    """True for vectors that aren't null or empty and hold finite numbers only."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def groups(column: pa.Array):
    """(dimension, row numbers) of each dimension found: vectors of another length meet no query of this one."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), np.flatnonzero(sizes == d)


def as_block(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["data"], np.float64).reshape(len(ids), row["dim"])


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (id long, v array<double>) as blocks of at most ``rows`` rows; a task's rows keep their order.
    ``longest`` is the largest Euclidean length in the block."""

    def run(batches):
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def block(d):
            ids, data = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            sizes.pop(d)
            for lo in range(0, len(ids), rows):
                i, x = ids[lo:lo + rows], np.ascontiguousarray(data[lo:lo + rows])
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([int(i[0])], pa.int64()), "n": pa.array([len(i)], pa.int32()), "dim": pa.array([d], pa.int32()),
                    "longest": [float(np.sqrt((x * x).sum(axis=1).max()))], "ids": pa.array([i.tobytes()], pa.binary()),
                    "data": pa.array([x.tobytes()], pa.binary())})

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for d, at in groups(batch.column("v")):
                part = batch.column("v").take(pa.array(at))
                held.setdefault(d, []).append((ids[at], matrix(part)))
                sizes[d] = sizes.get(d, 0) + len(at)
                if sizes[d] >= rows:
                    yield from block(d)
        for d in list(held):
            yield from block(d)

    return df.select("id", "v").mapInArrow(run, BLOCK_SCHEMA)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score first, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))][:k]
