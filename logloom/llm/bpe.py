"""Operator 5: exact byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word ends in exactly one token. An automaton with suffix links finds all
tokens that end at a position, longest first; a token is the last one of that prefix when it may follow the
last token of the prefix before it, which a pair test on the merge trees decides. Following the stored
tokens back from the end gives the ids. The time is linear in the word, however long it is.

Defined cases: a null or empty text has no ids and decodes to the empty string; a special token's content
in a text is that token (added tokens come first, as in the tokenizers library); repeated rows stay; other
columns pass through, but one named as the output column is replaced.
"""

from __future__ import annotations

import functools
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table
from .pieces import PieceEncoder

NEVER = 1 << 60


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 characters stand for themselves,
    the other bytes take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _bytes_of(spec: dict) -> dict[int, bytes]:
    to_byte, added = byte_alphabet(), {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    return {i: bytes(to_byte[c] for c in token) for token, i in spec["model"]["vocab"].items() if i not in added} | added


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each token: all that decoding needs of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return _bytes_of(json.load(f))


class Vocabulary:
    """Merge trees, the automaton and the pair test of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cutter = spec["model"], spec["pre_tokenizer"]
        added = [a for a in spec["added_tokens"]]
        if (spec["normalizer"] or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
                or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or not cutter.get("use_regex", True)
                or len(added) > 1 or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)):
            raise ValueError("only plain byte-level BPE files are supported")
        self.special = added[0]["content"] if added else None
        special_id = added[0]["id"] if added else None
        self.bytes_of = _bytes_of(spec)
        vocab, self.rank, self.made_of = model["vocab"], {}, {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            self.made_of.setdefault(whole, (a, b, r))
        self.automaton = ahocorasick.Automaton()
        single = {i for i, x in self.bytes_of.items() if len(x) == 1}
        for i, x in self.bytes_of.items():
            if i != special_id and (i in self.made_of or i in single):
                self.automaton.add_word(x.decode("latin-1"), (len(x), i))
        self.automaton.make_automaton()
        self.special_id = special_id
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._follows: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token that touch its left (0) or right (1) end while it is built, each with the
        rank of the merge that takes it up."""
        known = self._edges.get((token, side))
        if known is None:
            known, part, taken = [], token, NEVER
            while True:
                known.append((part, taken))
                if part not in self.made_of:
                    break
                taken = self.made_of[part][2]
                part = self.made_of[part][side]
            self._edges[token, side] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        """True if BPE over the bytes of both tokens gives these two tokens: no merge across their border
        comes before the merges that take up the parts on its two sides. Merges of one rank run from left
        to right, so a tie goes to the left part's own merge and goes against the right part's."""
        known = self._follows.get((left, right))
        if known is None:
            rank, known = self.rank, True
            for a, a_taken in self._edge(left, 1):
                for b, b_taken in self._edge(right, 0):
                    r = rank.get((a, b))
                    if r is not None and r < a_taken and r <= b_taken:
                        known = False
                        break
                if not known:
                    break
            if len(self._follows) > 400_000:
                self._follows.clear()
            self._follows[left, right] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known, follows = self._follows.get, self.follows
        for end, (width, token) in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - width
            if start:
                before = last[start]
                ok = known((before, token))
                if ok is None:
                    ok = follows(before, token)
                if not ok:
                    continue
            last[end], size[end] = token, width
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def encode_words(self, words: list[str]) -> list[bytes]:
        return [np.array([self.special_id] if w == self.special else self.encode_word(w.encode()), "<u4").tobytes()
                for w in words]


@functools.cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def _encoder(path: str) -> PieceEncoder:
    v = _vocabulary(path)
    return PieceEncoder(v.encode_words, v.special, memory=300_000)


def _parts(batch: pa.RecordBatch, sizes: pa.Array, most: int):
    """Slices of consecutive rows of about ``most`` in all, so that the working set of a worker stays small."""
    bounds = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    for i, j in chunks(bounds, most):
        yield batch.slice(i, j - i)


def _ids_of(batch: pa.RecordBatch, text: str, path: str) -> pa.Array:
    """The ids of each text of a batch as a list column."""
    flat, sizes = _encoder(path).encode_flat([t or "" for t in batch.column(text).to_pylist()])
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view("<i4"), pa.int32()))


def _texts_of(column: pa.Array, parts: dict[int, bytes]) -> pa.Array:
    """The text of each id list of a column."""
    column = column.fill_null([]) if column.null_count else column
    flat, bounds = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(False))])
    return pa.array([b"".join(map(parts.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace")
                     for a, b in zip(bounds[:-1].astype(int).tolist(), bounds[1:].astype(int).tolist(), strict=True)], pa.string())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str | None = None, decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text as ``ids`` (array<int>). With ``decoded`` also the text that the
    ids decode to, as that column: the same worker decodes them, so no second one holds a vocabulary."""
    path = tokenizer or default_tokenizer()
    df = df.drop(ids, *[decoded] * (decoded is not None))
    names = df.columns
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded is not None:
        added.append(T.StructField(decoded, T.StringType()))

    def run(batches):
        for batch in (part for whole in batches for part in _parts(whole, pc.binary_length(whole.column(text)), 4_000_000)):
            columns = [_ids_of(batch, text, path)]
            if decoded is not None:
                columns.append(_texts_of(columns[0], _vocabulary(path).bytes_of))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *(f.name for f in added)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """``df`` with the text of each id list as ``text``; special tokens are kept, bytes that are not UTF-8
    become U+FFFD, a null list is the empty text."""
    path = tokenizer or default_tokenizer()
    df = df.drop(text)
    names = df.columns

    def run(batches):
        parts = token_bytes(path)
        for batch in (part for whole in batches for part in _parts(whole, pc.list_value_length(whole.column(ids)), 1_000_000)):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _texts_of(batch.column(ids), parts)], [*names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
