"""What the operators of this subpackage share: inputs, durable intermediate tables, byte views of Arrow text."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Only a local master may
    do without it, as there is one machine then."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, compression: str = "lz4") -> DataFrame:
    """The same rows from a table written to the shared folder: lineage ends there, so that a lost
    executor costs a read and not the work before."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession):
    """What is written, or made and collected, inside gives its shuffle files back when it ends; else they stay until the
    driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def release() -> None:
    """Frees what a reused worker still holds of another operator's tasks: vocabularies, remembered words and pieces, unused memory.
    Only the memory changes; who needs them again loads them again."""
    caches = [f for name in ("bpe", "packing", "tokenfile") for f in vars(sys.modules.get(f"{__package__}.{name}", object)).values()
              if hasattr(f, "cache_clear")]
    if any(f.cache_info().currsize for f in caches):
        for f in caches:
            f.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc keeps freed blocks otherwise
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string or binary Arrow array without copying the text; null is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, most: int):
    """Runs [i, j) of consecutive documents of about ``most`` bytes, one document at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
