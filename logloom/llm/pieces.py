"""Whole-text tokenization through repeated pieces.

A text is cut before each space that follows a character other than white space. Byte-level BPE always
starts a new word there, so the ids of a text are the ids of its pieces in order; pieces repeat, and each
worker process encodes a piece once and remembers it. Only the memory is bounded; results never depend on
it.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the word pattern of the public byte-level BPE tokenizers.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=\S) ")


class Memory:
    """A bounded dictionary: when the young half is full it becomes the old half, and what is asked for
    again moves back, so that frequent entries stay."""

    def __init__(self, most: int):
        self.young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._most = most // 2

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of the distinct ``keys`` that it doesn't have; all others are in ``young`` afterwards."""
        if len(self.young) > self._most:
            self._old, self.young = self.young, {}
        young, old, out = self.young, self._old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out


class PieceEncoder:
    """ids of texts as little-endian uint32 bytes. ``encode_words`` gives the ids of words (no white space
    rule left to apply) that are not in memory, ``encode_pieces``, if given, those of whole pieces that stand after a
    space: none of them is empty, ends in white space or holds the special token."""

    def __init__(self, encode_words, special: str | None = None, memory: int = 800_000, encode_pieces=None):
        self._encode_words, self._encode_pieces = encode_words, encode_pieces
        self._pieces, self._words = Memory(memory), Memory(memory)
        self._cut_special = regex.compile(f"({regex.escape(special)})") if special else None
        self._special = special

    def _split(self, piece: str) -> list[str]:
        if self._special is None or self._special not in piece:
            return WORDS.findall(piece)
        return [w for part in self._cut_special.split(piece) for w in
                ([part] if part == self._special else WORDS.findall(part))]

    def _learn(self, pieces: list[str], space: str) -> list[bytes]:
        """Ids of pieces with ``space`` before each."""
        cut, split = [], self._split
        for p in pieces:
            if p.isalpha():
                cut.append((space + p,))
            elif p[:-1].isalpha() and p[-1] in ",.;:!?":
                cut.append((space + p[:-1], p[-1]))
            else:
                cut.append(split(space + p))
        wanted = {w for words in cut for w in words}
        unknown = self._words.missing(wanted)
        memory = self._words.young
        memory.update(zip(unknown, self._encode_words(unknown), strict=True))
        return [memory[c[0]] if len(c) == 1 else b"".join([memory[w] for w in c]) for c in cut]

    def _learnt(self, pieces: list[str]) -> Iterable[tuple[str, bytes]]:
        """Ids of pieces that stand after a space."""
        if self._encode_pieces is None:
            return zip(pieces, self._learn(pieces, " "), strict=True)
        other = [p for p in pieces if not p or p[-1].isspace() or (self._special is not None and self._special in p)]
        whole = list(set(pieces).difference(other)) if other else pieces
        return chain(zip(whole, self._encode_pieces(whole), strict=True), zip(other, self._learn(other, " "), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.encode_flat(texts)
        ends, data = (np.cumsum(sizes) * 4).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        gc.disable()  # millions of strings and no cycles: collecting would only walk over them
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, order, bounds = _coded(pc.split_pattern(pa.array(texts, pa.large_string()), " "))
        unknown = self._pieces.missing(pieces)
        # a space after white space is no border: those texts are cut again, elsewhere
        loose = [p for p in unknown if not p or p[-1].isspace()]
        if loose:
            held = np.zeros(len(pieces), bool)
            place = {p: i for i, p in enumerate(pieces)}
            held[[place[p] for p in loose]] = True
            hits = held[order]
            hits[bounds[1:] - 1] = False
            again = set((np.searchsorted(bounds, np.flatnonzero(hits), side="right") - 1).tolist())
            if again:
                cut = [_CUT.split(t) if i in again else t.split(" ") for i, t in enumerate(texts)]
                pieces, order, bounds = _coded(pa.array(cut, pa.list_(pa.large_string())))
                unknown = self._pieces.missing(pieces)
        heads = self._learn([pieces[i] for i in order[bounds[:-1]].tolist()], "")
        order[bounds[:-1]] = len(pieces) + np.arange(len(heads))  # the first piece of a text has no space before it
        memory = self._pieces.young
        memory.update(self._learnt(unknown))
        parts = [*map(memory.__getitem__, pieces), *heads]
        for p in unknown if loose else ():  # must stay unknown: they tell which texts to cut again
            if not p or p[-1].isspace():
                del memory[p]
        each = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        sizes, flat = each[order], as_ids(b"".join(parts))
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat((np.cumsum(each) - each)[order] - before[:-1], sizes)
        at += np.arange(before[-1])
        return flat[at], before[bounds[1:]] - before[bounds[:-1]]


def _coded(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces, the piece at each place, first place of each text and the end)."""
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)


def as_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def slices(texts: list[str], most: int = 4_000_000):
    """Consecutive texts of about ``most`` characters, so that the working set stays small."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
