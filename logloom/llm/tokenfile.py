"""Operator 7: token ids in binary blocks, coded as Simple-8b words.

A block holds whole documents in ascending doc_id order: a header, an index of the documents, an offset
index, then 64-bit words. The top four bits of a word select how many ids of how many bits it holds; an id
of 30 bits or more is escaped into a word of its own. The offset index has the word at which every run of
``RUN`` ids begins (a word never crosses such a border), so that any run decodes alone and all runs decode
as one vectorised pass. Blocks are stored as rows of a Parquet table, the one carrier of binary data that
Spark's writers commit atomically on any store.

Defined cases: a null or empty text has the end id only; a null doc_id sorts first and stays null; rows
that repeat stay, in any order among themselves; columns besides doc_id and text are not written.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_tokenizer
from .common import shared_dir, table
from .pieces import PieceEncoder, slices

#: Fixed values: (ids in a word, bits of each) by selector; the last one is the escape.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10),
             (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([c for c, _ in SELECTORS], np.int64)
#: The first value too large for widths 0, 1, 2 ... 30 bits: selectors 0 and 1 share width 0.
WIDTHS = np.array([1 << bits for _, bits in SELECTORS[1:-1]], np.uint64)
#: The same search looked up for ids below 2**16.
NARROW = np.searchsorted(WIDTHS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
RUN = 1 << 15
MAGIC = 0x4B38425349  # the five bytes "ISB8K"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each run) of unsigned ids below 2**60."""
    words, offsets, at = [], [], 0
    for lo in range(0, len(ids), RUN):
        part = _pack_run(ids[lo:lo + RUN].astype(np.uint64))
        offsets.append(at)
        words.append(part)
        at += len(part)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(offsets, np.int64)


def _pack_run(ids: np.ndarray) -> np.ndarray:
    n = len(ids)
    if n and int(ids.max()) >> 60:
        raise ValueError("ids must be below 2**60")
    # the least width that holds each id, and the maxima of it over ever longer windows
    widest = NARROW[ids] if n and int(ids.max()) < len(NARROW) else np.searchsorted(WIDTHS, ids, side="right").astype(np.uint8)
    choice, window, narrow, high = np.full(n, 15, np.uint8), 1, widest, widest.max(initial=0)
    for s in range(14, -1, -1):
        count = SELECTORS[s][0]
        while window < count:
            step = min(window, count - window)
            narrow = np.concatenate([np.maximum(narrow[:-step], narrow[step:]), narrow[-step:]]) if step < n else np.full(
                n, high, np.uint8)
            window += step
        fits = narrow <= max(s - 1, 0)
        if not fits.any():
            break
        np.putmask(choice, fits, np.uint8(s))
    starts = _starts(np.append(np.minimum(np.arange(n) + COUNTS[choice], n), n))
    picked = choice[starts]
    out = picked.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for s in np.flatnonzero(np.bincount(picked, minlength=16)):
        count, bits = SELECTORS[s]
        if bits:
            rows = np.flatnonzero(picked == s)
            at = starts[rows]
            word = padded[at]
            for k in range(1, count):
                word |= padded[at + k] << np.uint64(k * bits)
            out[rows] |= word
    return out


def _starts(following: np.ndarray) -> np.ndarray:
    """The places that are reached from 0 before the last one: every 16th by steps, those between all at once."""
    n, far, i, some = len(following) - 1, following, 0, []
    for _ in range(4):
        far = far[far]
    while i < n:
        some.append(i)
        i = int(far[i])
    at = np.empty((len(some), 16), np.int64)
    at[:, 0] = some
    for k in range(1, 16):
        at[:, k] = following[at[:, k - 1]]
    return at[at < n]


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids again; the ids that a run's last word pads are cut off."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    sizes = np.full(len(offsets), RUN, np.int64)
    if len(offsets):
        sizes[-1] = n - RUN * (len(offsets) - 1)
    ends = np.concatenate([offsets[1:], [len(words)]]).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    run = np.repeat(np.arange(len(offsets)), ends - offsets)
    start = before[:-1] - before[offsets][run] + run * RUN if len(words) else np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    stop = run * RUN + sizes[run] if len(words) else start
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(selector == s)
        if not bits or not len(rows):
            continue
        at = start[rows][:, None] + np.arange(count)
        shifts = (np.arange(count) * bits).astype(np.uint64)
        values = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
        ok = at < stop[rows][:, None]
        out[at[ok]] = values[ok]
    return out


def write_block(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    header = np.array([MAGIC, len(doc_ids), len(ids), len(offsets), len(words)], "<i8")
    known = np.array([d is not None for d in doc_ids], "<i8")
    return b"".join(x.tobytes() for x in (header, known, np.array([d or 0 for d in doc_ids], "<i8"),
                                          sizes.astype("<i8"), offsets.astype("<i8"), words.astype("<u8")))


def read_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids)."""
    whole = np.frombuffer(data, "<i8")
    magic, docs, n, runs, words = whole[:5].tolist()
    if magic != MAGIC or len(whole) != 5 + 3 * docs + runs + words:
        raise ValueError("not a token block")
    known, doc_ids, sizes, offsets, coded = np.split(whole[5:], np.cumsum([docs, docs, docs, runs]))
    return [d if k else None for k, d in zip(known.tolist(), doc_ids.tolist(), strict=True)], sizes, unpack(
        coded.view("<u8"), offsets, n)


@functools.cache
def _encoder(path: str) -> PieceEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder()
    special = next((t.content for t in added.values()), None)

    def alone(words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    width = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        width[i] = len(token)  # a character of the byte alphabet for each byte

    def pieces_of(pieces: list[str]) -> list[bytes]:
        """Pieces stay apart when they are joined by spaces, so thousands go in one call; the bytes that tokens
        stand for tell which tokens belong to which piece."""
        out = []
        for lo in range(0, len(pieces), 4096):
            some = pieces[lo:lo + 4096]
            joined = " " + " ".join(some)
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            lengths = np.fromiter(map(len, some if joined.isascii() else map(str.encode, some)), np.int64, len(some))
            ends = ((np.searchsorted(np.cumsum(width[ids]), np.cumsum(lengths + 1)) + 1) * 4).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    return PieceEncoder(alone, special, 1_600_000, pieces_of)


def write_tokens(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, block_ids: int = 1 << 20) -> None:
    """Writes the ids of every text and ``end_id`` after each, in ascending doc_id order: part files hold
    consecutive ranges of doc_id, blocks of a part follow ``block``."""
    source = tokenizer or default_tokenizer()

    def run(batches):
        doc_ids, coded, size, k = [], [], 0, 0

        def block():
            sizes = np.array([len(x) for x in coded], np.int64)
            data = write_block(doc_ids, sizes, np.concatenate(coded))
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(sizes.sum())], pa.int64()), pa.array(
                [data], pa.binary())], ["block", "n_ids", "data"])

        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for part in slices([t or "" for t in batch.column("text").to_pylist()], 8_000_000):
                flat, sizes = _encoder(source).encode_flat(part)
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, end_id)
                for x in np.split(flat, (ends + np.arange(1, len(ends) + 1))[:-1]):
                    doc_ids.append(ids[at])
                    coded.append(x)
                    at, size = at + 1, size + len(x)
                    if size >= block_ids:
                        yield block()
                        doc_ids, coded, size, k = [], [], 0, k + 1
        if doc_ids:
            yield block()

    (df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
     .sortWithinPartitions("doc_id").mapInArrow(run, "block int, n_ids long, data binary")
     .withColumn("part", F.spark_partition_id()).write.parquet(path, compression="uncompressed"))


def read_tokens(spark, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids (array<long>) of each document."""
    blocks = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for part, k, data in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column(
                    "data"), strict=True):
                docs, sizes, flat = read_block(data.as_py())
                ends = np.cumsum(sizes)
                raw = flat.astype("<u4")
                view = memoryview(raw).cast("B")
                crcs = [zlib.crc32(view[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                m = len(docs)
                columns = [pa.array(np.full(m, part), pa.int32()), pa.array(np.full(m, k), pa.int32()), pa.array(
                    docs, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if ids:
                    bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int64), pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    rows = blocks.select("part", "block", "data").mapInArrow(run, schema)
    # ids before each part, then before each block of it: no window holds more than one part's blocks
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(
        F.sum("n").over(parts), F.lit(0)).alias("before_part"))
    of_block = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before_block"))
    return (rows.join(of_block.join(of_part, "part"), ["part", "block"])
            .select("doc_id", (F.col("before_part") + F.col("before_block") + F.col("inside")).alias("start"), "n_tokens",
                    "ids_crc32", *["ids"] * ids))


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, ids=False)


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
