"""Operator 13: harmonic packing of documents into sequences of bounded length.

The capacity C and its reciprocals give the classes: lengths C // k for k = 1, 2, 3 ... (about 2 * sqrt(C) of
them, every small length among them). A document is cut into pieces of class lengths, the largest that fits
first: whole sequences, then a rest that is seldom more than two or three pieces. A bin of the class of length v
holds C // v pieces, a fixed count, and so at most min(v, C // v) ids of padding. Every worker fills the bins of
each class by itself as its documents come; what is left in its open bins is bounded (a bin of each class) and goes
to a next round, where a worker takes the remains of ``FAN`` workers, until one worker has the remains of FAN at
most. There the remains are laid end to end and cut at every C ids; the end is cut into powers of two, which need
no padding. No step holds more than the open bins of FAN workers.

A piece carries its ids, so that ``sequences`` puts sequences together with one shuffle on their number. The ids
are those of the tokenizer for the whole text: words are encoded once and remembered, as its rules drop white space
and never join words over it. The memory is bounded by bytes; results don't depend on it.

Defined cases: a null or empty text is its end id alone; a null doc_id stays null; rows that repeat are packed one
by one; an empty table has no pieces; other columns are not carried.
"""

from __future__ import annotations

import functools
import gc
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .pieces import slices

FAN = 16
SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary,"
          " worker long, place long")


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- ids
#: Python's split() takes these for white space, the tokenizer's rules don't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[^\\S\x1c-\x1f]+")
#: A Latin word and marks after it: the word pattern always cuts between them.
_MARKED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#-&*-/:;=?@^_`~]*)")


class WordEncoder:
    """ids (little-endian uint32 bytes) of whole texts for tokenizers that drop white space and end each word's
    last token with a suffix. When the young half of the memory is full it becomes the old half; what is asked for
    again moves back, so that frequent words stay."""

    def __init__(self, path: str, memory: int = 256 << 20, suffix: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._ends = np.zeros(self._tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self._ends[[i for t, i in self._tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._used, self._most = 0, memory // 2

    def _alone(self, words: list[str]) -> None:
        for e, w in zip(self._tokenizer.encode_batch_fast(words, add_special_tokens=False), words, strict=True):
            self._keep(w, np.array(e.ids, "<u4").tobytes())

    def _together(self, words: list[str]) -> None:
        """Words that are one word by the tokenizer's rules: many in one call, told apart by their last tokens."""
        for lo in range(0, len(words), 256):
            some = words[lo:lo + 256]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            for w, i, j in zip(some, [0, *ends[:-1]], ends, strict=True):
                self._keep(w, data[i:j])

    def _keep(self, word: str, ids: bytes) -> None:
        self._young[word] = ids
        self._used += 200 + len(word) + len(ids)  # both objects and their place in the dictionary

    def _missing(self, words: set[str]) -> list[str]:
        """Those that must be learnt; the others are in the young half afterwards."""
        out = []
        for w in words.difference(self._young):
            ids = self._old.get(w)
            if ids is None:
                out.append(w)
            else:
                self._keep(w, ids)
        return out

    def _learn(self, words: list[str]) -> None:
        marked, plain, other = [], set(), []
        for w in words:
            m = _MARKED.fullmatch(w)
            if m:
                core, marks = m[1].lower(), m[2]
                plain.add(core)
                if marks:
                    plain.add(marks)
                    marked.append((w, core, marks))
                elif core != w:
                    marked.append((w, core, None))
            else:
                other.append(w)
        self._together(self._missing(plain))
        self._alone(other)
        ids = self._young
        for w, core, marks in marked:
            self._keep(w, ids[core] + ids[marks] if marks else ids[core])

    def encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # many strings and no cycles
        try:
            if self._used > self._most:
                self._old, self._young, self._used = self._young, {}, 0
            cut = [[w for w in _SPACES.split(t) if w] if _SEPARATORS.search(t) else t.split() for t in texts]
            self._learn(self._missing(set().union(*cut)))
            get = self._young.__getitem__
            return [b"".join(map(get, c)) for c in cut]
        finally:
            gc.enable()


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---------------------------------------------------------------- bins
def classes(capacity: int) -> list[int]:
    """All lengths capacity // k, longest first."""
    out, k = [], 1
    while k <= capacity:
        out.append(capacity // k)
        k = capacity // (capacity // k) + 1
    return out


def cut(n: int, capacity: int, lengths: np.ndarray) -> list[int]:
    """Class lengths that add up to ``n``; ``lengths[r]`` is the longest one of at most r ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        out.append(int(lengths[rest]))
        rest -= out[-1]
    return out


def _longest(capacity: int) -> np.ndarray:
    out = np.zeros(capacity + 1, np.int64)
    out[classes(capacity)] = classes(capacity)
    return np.maximum.accumulate(out)


class Bins:
    """One worker's open bins. ``add`` hands out a bin when it is full; ``rest`` are the pieces in open ones."""

    def __init__(self, capacity: int, prefix: int):
        self.capacity, self._next, self._open = capacity, prefix << 32, {}

    def add(self, length: int, piece: tuple) -> list[tuple]:
        """``piece``: (doc_id, start, doc_tokens, ids). Rows (doc_id, start, length, doc_tokens, sequence_id, offset, ids)."""
        waiting = self._open.setdefault(length, [])
        waiting.append(piece)
        if len(waiting) < self.capacity // length:
            return []
        rows = [(d, s, length, n, self._next, i * length, ids) for i, (d, s, n, ids) in enumerate(waiting)]
        waiting.clear()
        self._next += 1
        return rows

    def rest(self) -> list[tuple]:
        return [(d, s, length, n, None, None, ids) for length in sorted(self._open, reverse=True) for d, s, n, ids in self._open[length]]


def _borders(total: int, capacity: int) -> np.ndarray:
    """Where sequences begin and end when ``total`` ids lie end to end: every ``capacity``, then powers of two."""
    at, left = list(range(0, total - total % capacity + 1, capacity)), total % capacity
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            at.append(at[-1] + (1 << bit))
    return np.array(at, np.int64)


def laid_out(pieces: list[tuple], capacity: int, prefix: int) -> list[tuple]:
    """Rows of ``pieces`` (doc_id, start, length, doc_tokens, _, _, ids) laid end to end and cut at the borders."""
    borders, at, out = _borders(sum(p[2] for p in pieces), capacity), 0, []
    for d, s, length, n, _, _, ids in pieces:
        k, done = int(np.searchsorted(borders, at, side="right")) - 1, 0
        while done < length:
            some = min(length - done, int(borders[k + 1]) - at)
            out.append((d, s + done, some, n, (prefix << 32) + k, at - int(borders[k]), ids[4 * done:4 * (done + some)]))
            at, done, k = at + some, done + some, k + 1
    return out


def _batch(rows: list[tuple], worker: int, first: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(columns)]
    arrays += [pa.array(np.full(len(rows), worker), pa.int64()), pa.array(np.arange(first, first + len(rows)), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])


# ---------------------------------------------------------------- rounds
def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all texts of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens (with ``end_id``), sequence_id,
    offset (the piece's first id there) and ids (little-endian uint32)."""
    path, end, lengths = tokenizer or word_tokenizer(), np.array([end_id], "<u4").tobytes(), _longest(capacity)

    def first(batches):
        worker, made = TaskContext.get().partitionId(), 0
        bins, rows = Bins(capacity, worker), []
        for batch in batches:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in slices([t or "" for t in batch.column("text").to_pylist()], 2_000_000):
                for ids in _encoder(path).encode(texts):
                    ids, start = ids + end, 0
                    n = len(ids) // 4
                    for length in cut(n, capacity, lengths):
                        rows += bins.add(length, (doc_ids[at], start, n, ids[4 * start:4 * (start + length)]))
                        start += length
                    at += 1
                    if len(rows) >= 20_000:
                        yield _batch(rows, worker, made)
                        made, rows = made + len(rows), []
        rows += bins.rest()
        if rows:
            yield _batch(rows, worker, made)

    def following(turn: int, last: bool):
        def run(key, got):
            group = key[0].as_py()
            prefix, rows = (turn << 25) + group, []
            got = got.sort_by([("length", "descending"), ("worker", "ascending"), ("place", "ascending")])
            pieces = list(zip(*(got.column(c).to_pylist() for c in (
                "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")), strict=True))
            if last:
                rows = laid_out(pieces, capacity, prefix)
            else:
                bins = Bins(capacity, prefix)
                for d, s, length, n, _, _, ids in pieces:
                    rows += bins.add(length, (d, s, n, ids))
                rows += bins.rest()
            return pa.Table.from_batches([_batch(rows, group, 0)])
        return run

    done, turn = [], 0
    now = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, SCHEMA), "zstd")
    while True:
        done.append(now.filter("sequence_id is not null"))
        left = now.filter("sequence_id is null")
        most = left.agg(F.max("worker").alias("m")).first()["m"]
        if most is None:
            break
        turn, last = turn + 1, most < FAN
        groups = left.withColumn("group", F.floor(F.col("worker") / FAN).cast("long"))
        now = saved(groups.groupBy("group").applyInArrow(following(turn, last), SCHEMA), "zstd")
    return functools.reduce(DataFrame.unionByName, done).drop("worker", "place")


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, used (ids that are no padding) and ids (array<long>, padded to ``capacity`` unless their number is a
    power of two) of every sequence."""
    def run(key, got):
        got = got.sort_by("offset")
        ids = np.frombuffer(b"".join(got.column("ids").to_pylist()), "<u4").astype(np.int64)
        n = len(ids)
        padded = ids if n & n - 1 == 0 else np.concatenate([ids, np.full(capacity - n, pad_id, np.int64)])
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array(
            [padded], pa.list_(pa.int64()))], ["sequence_id", "used", "ids"])

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(
        run, "sequence_id long, used long, ids array<long>")


def op13_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op13_packing": op13_packing}
ORACLES: dict[str, str] = {}
