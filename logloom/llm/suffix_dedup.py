"""Operator 6: removal of repeated substrings through a partitioned suffix sort.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a document of a smaller doc_id. The
suffixes of all documents (their first WIDTH bytes decide) are range-partitioned by sampled splitters and
sorted in their buckets by a multikey sort, eight bytes as one character, where only suffixes that still tie
go on to the next character. Neighbours that agree to the end are equal strings; the least doc_id owns them.

A suffix is not shipped alone. Its key is the least hash of the ANCHOR-byte strings in its first WIDTH bytes:
equal suffixes have equal keys, and neighbours in a text mostly share one, so runs of suffixes with one key
travel as one segment of text. Equal suffixes never fall into two buckets, so no comparison crosses a border.
Before that, anchors are counted with the bytes beside them: only segments with an anchor that repeats
together with its left or its right side travel (a bitmap of bounded size says which, with some false
positives and no misses). Of equal segments a task sends the one of
the least doc_id; the others are decided there. Shuffle files go as soon as their stage has been used. Keys with very many segments, as at the edges of a passage
that a large part of the documents share, are dealt suffix by suffix over all tasks.

Defined cases: a null or empty text has no bytes; repeats within a document don't count, nor between rows of
one doc_id; a null doc_id counts as the smallest; an empty table gives an empty result; other columns pass
through ``deduplicate``, those named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, freed, saved, table, text_bytes

WIDTH, ANCHOR, SIDE, CHUNK, KEY_BITS = 50, 24, 13, 1 << 18, 36
#: The bitmap has 8 bits for each hash that repeats, between 2 to the power of these (16 and 64 MB).
FILTER_BITS, FILTER_MOST = 27, 29
#: Buckets of a shuffle partition, as long as there are no more than MOST_BUCKETS; with more the packs, one for each
#: bucket and flush, would hold a few segments only and hardly compress.
BUCKETS, MOST_BUCKETS, LEAST_BUCKETS, LEVEL = 16, 2048, 2, 6
#: Segments of one key (about 3 MB of text at this number, as much as a task can hold of one key) above which
#: its suffixes are dealt one by one; segments held before a task sends them; segments of a bucket solved at a time.
HOT, HELD, SOLVED = 50_000, 400_000, 60_000
NULL_ID = -(1 << 63)

_RANDOM = np.random.default_rng(50_024)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_M = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _fold(h: np.ndarray, gap: int, m: np.uint64, other: np.ndarray | None = None) -> np.ndarray:
    other = h if other is None else other
    n = len(other) - gap
    return h[:n] * m + other[gap:gap + n]


def _sliding(x: np.ndarray, span: int, best) -> np.ndarray:
    have = 1
    while have < span:
        step = min(have, span - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, number of suffixes, key) of the runs of suffixes with one key, in text order; and of
    every anchor (document and place of the string whose hash is a key) the segment and two hashes: of the
    anchor with SIDE bytes before it and with SIDE bytes behind it. A string of WIDTH bytes around an anchor
    holds one of the two whole, so a repeated string has one that repeats; 0 stands where a text ends."""
    n, none = len(data), np.zeros(0, np.int64)
    empty = (none, none, none, np.zeros(0, np.uint64), none, np.zeros((0, 2), np.uint64))
    if n < WIDTH:
        return empty
    h1 = _BYTE[data]
    h2 = _fold(h1, 1, _M[0])
    h4 = _fold(h2, 2, _M[1])
    h8 = _fold(h4, 4, _M[2])
    h16 = _fold(h8, 8, _M[3])
    raw = _mix(_fold(h16[:n - ANCHOR + 1], 16, _M[4], h8)[:n - ANCHOR + 1])
    span = WIDTH - ANCHOR + 1
    low = _sliding(raw, span, np.minimum)[:n - WIDTH + 1]
    rooms = np.maximum(np.diff(bounds) - WIDTH + 1, 0)
    doc = np.repeat(np.arange(len(rooms)), rooms)
    at = np.arange(len(doc)) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(rooms)])[:-1], rooms)
    if not len(at):
        return empty
    keys = low[at]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]))
    first, count, key = at[new], np.diff(np.append(new, len(at))), keys[new]
    # the anchors of a segment lie between its start and the last place that its last suffix holds one
    real = np.zeros(n + 1, np.uint64)  # only suffixes within a text count
    real[at] = keys
    top = _sliding(np.concatenate([np.zeros(span - 1, np.uint64), real]), span, np.maximum)[:len(raw)]
    places = np.flatnonzero(top == raw)
    lo, hi = np.searchsorted(places, first), np.searchsorted(places, first + count + span - 1)
    of = np.repeat(np.arange(len(first)), hi - lo)
    place = places[np.arange(len(of)) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)]
    own = raw[place] == key[of]
    of, place = of[own], place[own]
    whole = ANCHOR + SIDE
    wide = _fold(h16, 16, _M[5])
    m = max(n - whole + 1, 0)
    wide = _mix(wide[:m] * _M[6] + h4[32:32 + m] * _M[7] + h1[36:36 + m]) | np.uint64(1)
    begin, end = bounds[doc[new]][of], bounds[doc[new] + 1][of]
    left, right = place - SIDE, place
    sides = np.zeros((len(of), 2), np.uint64)
    for j, x in enumerate((left, right)):
        ok = (x >= begin) & (x + whole <= end)
        sides[ok, j] = wide[x[ok]]
    return doc[new], first - bounds[doc[new]], count, key, of, sides


def _pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes data[start:start + size] of all pieces, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _content(blob: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece's bytes."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    bounds, out = np.concatenate([[0], np.cumsum(sizes)]), np.empty(len(sizes), np.uint64)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, np.uint64(0x9E3779B97F4A7C15)))
    for i, j in chunks(bounds, CHUNK):
        starts = bounds[i:j] - bounds[i]
        place = np.arange(bounds[j] - bounds[i]) - np.repeat(starts, sizes[i:j])
        out[i:j] = np.add.reduceat(_BYTE[blob[bounds[i]:bounds[j]]] * powers[place], starts)
    return _mix(out + sizes.astype(np.uint64))


def _coded(keys: np.ndarray) -> bytes:
    """Sorted keys as 16-bit gaps; a gap of 65535 or more takes fillers of 65535 first."""
    gaps = np.diff(keys, prepend=np.int64(0))
    fill = gaps // 65535
    out = np.full(len(keys) + int(fill.sum()), 65535, np.uint16)
    out[np.cumsum(fill + 1) - 1] = gaps % 65535
    return out.tobytes()


def _decoded(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 65535]


def repeated_keys(docs: DataFrame, partitions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bitmap of the side hashes that occur more than once, keys of more than HOT segments, splitters of the
    keys), keys by their first KEY_BITS bits. Hashes move as sorted lists, a range of values at a time; each
    range owns a part of the bitmap, so what comes back has a bounded size and a key is hot only with HOT
    segments or more."""
    range_bits = max(4, (4 * partitions - 1).bit_length())
    width = KEY_BITS - range_bits

    def keys(batches):
        held, size = ([], []), 0

        def send():
            for kind, parts in enumerate(held):
                x = (np.sort(np.concatenate(parts)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
                cut = np.searchsorted(x >> width, np.arange((1 << range_bits) + 1))
                some = np.flatnonzero(np.diff(cut))
                inside = x & ((1 << width) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, np.int32)), pa.array(
                    [_coded(inside[cut[r]:cut[r + 1]]) for r in some], pa.binary())], ["range", "kind", "keys"])

        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for i, j in chunks(bounds, CHUNK):
                found = segments(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
                held[0].append(found[5][found[5] > 0])
                held[1].append(found[3])
                size += len(held[0][-1])
                if size > 2_000_000:
                    yield from send()
                    held, size = ([], []), 0
        if held[0]:
            yield from send()

    def count(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for r, kind, k in zip(batch.column("range").to_pylist(), batch.column("kind").to_pylist(), batch.column("keys"), strict=True):
                held.setdefault(r, ([], []))[kind].append(_decoded(k.as_py()))
        for r, (sides, parts) in held.items():
            x = np.sort(np.concatenate([np.zeros(0, np.int64), *sides]))
            twice = np.unique(x[1:][x[1:] == x[:-1]])
            own = max(3, min(FILTER_MOST, max(FILTER_BITS, ((8 * len(twice) << range_bits) - 1).bit_length())) - range_bits)
            bits = np.zeros(1 << own, bool)
            bits[twice >> (width - own)] = True
            k, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
            k += r << width
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "bits": [np.packbits(bits).tobytes()],
                                              "hot": [k[n > HOT].tobytes()], "sample": [k[len(k) // 64::max(1, len(k) // 32)].tobytes()]})

    with freed(docs.sparkSession):
        found = (docs.select("text").mapInArrow(keys, "range int, kind int, keys binary").repartition("range")
                 .mapInArrow(count, "range int, bits binary, hot binary, sample binary").collect())
    part = max((len(row["bits"]) for row in found), default=1)  # of every range; ranges with fewer bits have each of them several times
    bitmap = np.zeros(part << range_bits, np.uint8)
    for row in found:
        bits = np.frombuffer(row["bits"], np.uint8)
        if len(bits) < part:
            bits = np.packbits(np.repeat(np.unpackbits(bits), part // len(bits)))
        bitmap[row["range"] * part:(row["range"] + 1) * part] = bits
    join = lambda c: np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[c], np.int64) for r in found)]))
    sample = join("sample")
    buckets = max(min(BUCKETS * partitions, MOST_BUCKETS), LEAST_BUCKETS * partitions)
    return bitmap, join("hot"), sample[np.linspace(0, len(sample) - 1, buckets).astype(int)] if len(sample) else sample


def _runs(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching intervals of a document as one; input sorted by (doc, start) with rising ends."""
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])])) if len(doc) else np.zeros(0, int)
    return doc[new], start[new], stop[np.append(new[1:], len(doc)) - 1] if len(doc) else stop


_DECIDED = "doc long, crc long, start int, stop int"
_SENT = f"bucket int, pack binary, {_DECIDED}"
_ARROW = pa.schema([("bucket", pa.int32()), ("pack", pa.binary()), ("doc", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), (
    "stop", pa.int32())])


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, first all lowest bytes: what is equal in most numbers stands together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _packed(key, doc, crc, start, size, blob) -> bytes:
    """Segments as one compressed row, by document: their documents once, then a column after the other. Of a key 32
    bits travel: keys only bring together what may be equal, texts decide."""
    order = np.lexsort((start, crc, doc))
    blob = _pieces(blob, (np.cumsum(size) - size)[order], size[order])
    key, doc, crc, start, size = (x[order] for x in (key, doc, crc, start, size))
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])]))
    head = np.array([len(key), len(new), len(blob)], np.int64)
    raw = b"".join((head.tobytes(), _planes(np.diff(doc[new], prepend=np.int64(0))), _planes(crc[new]), _planes(np.diff(
        np.append(new, len(key))).astype(np.int32)), _planes(key.astype(np.uint32)), _planes(start.astype(np.int32)), _planes(
        (size - WIDTH).astype(np.int32)), blob.tobytes()))
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    raw, at = pa.decompress(data[8:], size, codec="zstd", asbytes=True), 24
    n, docs, width = np.frombuffer(raw, np.int64, 3).tolist()
    out = []
    for kind, count in ((np.int64, docs), (np.int64, docs), (np.int32, docs), (np.uint32, n), (np.int32, n), (np.int32, n)):
        each = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, each * count, at).reshape(each, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += planes.size
    doc, crc, count, key, start, length = out
    return [key, np.repeat(np.cumsum(doc), count), np.repeat(crc, count), start.astype(np.int64), length.astype(np.int64) + WIDTH,
            np.frombuffer(raw, np.uint8, width, at)]


def _sent(docs: DataFrame, shared) -> DataFrame:
    """Segments with repeated keys, packed by bucket, and intervals that a task could decide alone. ``shared``: the
    broadcast result of ``repeated_keys``."""

    def batch_of(columns: dict, n: int):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW],
                                          schema=_ARROW)

    def flush(held):
        _, hot_, splitters_ = shared.value
        key, doc, crc, start, size, blob = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()  # not twice in memory
        same = _content(blob, size)
        # of equal segments those of the least document stay
        order = np.lexsort((start, doc, same, key))
        first = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (same[order][1:] != same[order][:-1])])
        least = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        keep, gone = order[doc[order] == least], order[doc[order] != least]
        gone = gone[np.lexsort((start[gone], crc[gone], doc[gone]))]
        d, s, e = _runs(_pairs(doc[gone], crc[gone]), start[gone], start[gone] + size[gone])
        if len(d):
            at = gone[np.searchsorted(_pairs(doc[gone], crc[gone]), d)]
            yield batch_of({"bucket": (doc[at] % 1024).astype(np.int32), "doc": doc[at], "crc": crc[at], "start": s.astype(np.int32),
                            "stop": e.astype(np.int32)}, len(d))
        short = (key[keep] >> np.uint64(64 - KEY_BITS)).astype(np.int64)
        bucket = np.searchsorted(splitters_, short, side="right")
        if len(hot_):
            many = np.flatnonzero(hot_[np.minimum(np.searchsorted(hot_, short), len(hot_) - 1)] == short)
            bucket[many] = -1 - doc[keep[many]] % 1024  # any task may take them
        order = np.argsort(bucket, kind="stable")
        keep, bucket = keep[order], bucket[order]
        offset = np.cumsum(size) - size
        for part in np.split(np.arange(len(keep)), np.flatnonzero(np.diff(bucket)) + 1) if len(keep) else []:
            for lo in range(0, len(part), 20_000):
                at = keep[part[lo:lo + 20_000]]
                yield batch_of({"bucket": [int(bucket[part[0]])], "pack": [_packed(
                    key[at], doc[at], crc[at], start[at], size[at], _pieces(blob, offset[at], size[at]))]}, 1)

    def run(batches):
        bitmap, held, count = shared.value[0], [], 0
        bits = (8 * len(bitmap)).bit_length() - 1
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            ids, crcs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "crc"))
            for i, j in chunks(bounds, CHUNK):
                part = data[bounds[i]:bounds[j]]
                doc, start, n, key, of, sides = segments(part, bounds[i:j + 1] - bounds[i])
                bit = (sides >> np.uint64(64 - bits)).astype(np.int64)
                seen = (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 & (sides > 0)
                some = np.unique(of[seen.any(axis=1)])
                if not len(some):
                    continue
                doc, start, size = doc[some], start[some], n[some] + WIDTH - 1
                held.append((key[some], ids[i:j][doc], crcs[i:j][doc], start, size, _pieces(part, start + bounds[i:j][doc] - bounds[i], size)))
                count += len(some)
                if count > HELD:
                    yield from flush(held)
                    count = 0
        if held:
            yield from flush(held)

    return docs.select("doc", "crc", "text").mapInArrow(run, _SENT)


def _pairs(doc: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """(doc, crc) as one sortable value."""
    out = np.empty(len(doc), [("d", np.int64), ("c", np.int64)])
    out["d"], out["c"] = doc, crc
    return np.unique(out, return_inverse=True)[1] if len(out) else np.zeros(0, np.int64)


def multikey(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes that start at ``at`` those whose first WIDTH bytes occur again, in sorted order, and
    the number of the run of equal ones that each belongs to. Suffixes that tie with no other leave at once."""
    words = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):  # eight bytes as one big-endian character, for every position
        words = (words[:len(words) - width] << np.uint64(8 * width)) | words[width:]
    run = np.zeros(len(at), np.int64)
    for depth in [*range(0, WIDTH - 7, 8), *([WIDTH - 8] if WIDTH % 8 else [])]:
        char = words[at + depth]
        order = np.lexsort((char, run)) if depth else np.argsort(char, kind="stable")
        at, run, char = at[order], run[order], char[order]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (char[1:] != char[:-1])]) if len(at) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        ties = np.bincount(run, minlength=1)[run] > 1 if len(at) else new
        at, run = at[ties], run[ties]
    return at, run


def _bucket(key, doc, crc, start, size, blob):
    """Intervals (positions of segments, first byte, end) to remove in one bucket."""
    same = _content(blob, size)
    order = np.lexsort((doc, same, key))
    k, s, d = key[order], same[order], doc[order]
    first = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
    least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
    gone = order[d != least]
    out = [(gone, start[gone], start[gone] + size[gone])]
    # different segments of one key: their suffixes are sorted (with those that a document has twice)
    distinct = order[d == least]
    kinds = np.unique(key[distinct], return_inverse=True)[1]
    rivals = distinct[np.bincount(kinds)[kinds] > 1]
    if len(rivals):
        text = _pieces(blob, (np.cumsum(size) - size)[rivals], size[rivals])
        begins = np.cumsum(size[rivals]) - size[rivals]
        counts = size[rivals] - WIDTH + 1
        of = np.repeat(np.arange(len(rivals)), counts)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        at, run = multikey(text, begins[of] + inside)
        if len(at):
            seg = np.searchsorted(begins, at, side="right") - 1
            owner = np.full(run.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(owner, run, doc[rivals[seg]])
            lost = doc[rivals[seg]] > owner[run]
            at, seg = at[lost], seg[lost]
            order = np.argsort(at)
            at, seg = at[order], seg[order]
            s_, b_, e_ = _runs(seg, at - begins[seg], at - begins[seg] + WIDTH)
            out.append((rivals[s_], start[rivals[s_]] + b_, start[rivals[s_]] + e_))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def removals(docs: DataFrame) -> DataFrame:
    """doc, crc, start, stop: intervals of bytes to remove, possibly overlapping. ``docs``: doc, crc, text."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bitmap, hot, splitters = repeated_keys(docs, partitions)
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, hot, splitters))
    kinds = ["doc", "crc", "start", "stop", "string"]

    def solve(batches):
        """What is decided passes; cold buckets are solved; suffixes of hot keys come out one by one."""
        held, bucket = [], None

        def out(doc, crc, start, stop, string=None):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(crc, pa.int64()), pa.array(start, pa.int32()), pa.array(
                stop, pa.int32()), pa.nulls(len(doc), pa.binary()) if string is None else pa.array(string, pa.binary())], kinds)

        def done():
            key, doc, crc, start, size, blob = (np.concatenate(x) for x in zip(*map(_unpacked, held), strict=True))
            offset, order = np.cumsum(size) - size, np.argsort(key, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(key))  # a key's segments stay together
            cuts = np.unique(cuts[np.searchsorted(cuts, np.arange(SOLVED, len(key) + SOLVED, SOLVED).clip(max=len(key)))])
            for part in np.split(order, cuts[:-1]):
                at, lo, hi = _bucket(key[part], doc[part], crc[part], start[part], size[part], _pieces(blob, offset[part], size[part]))
                yield out(doc[part][at], crc[part][at], lo.astype(np.int32), hi.astype(np.int32))

        for batch in batches:
            plain = batch.filter(batch.column("pack").is_null())
            if plain.num_rows:
                yield out(*(plain.column(c) for c in kinds[:4]))
            for b, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack"), strict=True):
                if not pack.is_valid:
                    continue
                if b < 0:
                    _, doc, crc, start, size, blob = _unpacked(pack.as_py())
                    counts, text = size - WIDTH + 1, blob.tobytes()
                    of = np.repeat(np.arange(len(size)), counts)
                    inside = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                    at = (np.cumsum(size) - size)[of] + inside
                    first = (start[of] + inside).astype(np.int32)
                    yield out(doc[of], crc[of], first, first + WIDTH, [text[a:a + WIDTH] for a in at.tolist()])
                    continue
                if held and b != bucket:
                    yield from done()
                    held = []
                bucket = b
                held.append(pack.as_py())
        if held:
            yield from done()

    dealt = _sent(docs, shared).repartition("bucket").sortWithinPartitions("bucket")
    with freed(docs.sparkSession):
        found = saved(dealt.select("bucket", "pack", "doc", "crc", "start", "stop").mapInArrow(solve, f"{_DECIDED}, string binary"), "zstd")
    shared.destroy()
    out = found.filter("string is null").select("doc", "crc", "start", "stop")
    if len(hot):
        single = found.filter("string is not null")
        owner = single.groupBy("string").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last")
        lost = single.join(owner.select("string", "owner"), "string").filter("doc > owner")
        out = out.unionByName(lost.select("doc", "crc", "start", "stop"))
    return out


OUTPUTS = ("n_bytes", "n_removed", "n_spans", "kept")


def deduplicate(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans and the remaining bytes as ``kept``."""
    df = df.drop(*OUTPUTS)
    docs = df.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_doc"),
                     F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("_crc"))
    spans = removals(docs.select(F.col("_doc").alias("doc"), F.col("_crc").alias("crc"), F.col(text).alias("text")))
    spans = spans.groupBy("doc", "crc").agg(F.collect_list("start").alias("_starts"), F.collect_list("stop").alias("_stops"))
    met = docs.join(spans.toDF("_doc", "_crc", "_starts", "_stops"), ["_doc", "_crc"], "left").select(*df.columns, "_starts", "_stops")
    names = df.columns

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column(text))
            sizes, removed, runs, kept = np.diff(bounds), [], [], []
            starts, stops = batch.column("_starts"), batch.column("_stops")
            for r in range(len(sizes)):
                own = data[bounds[r]:bounds[r + 1]]
                if not starts[r].is_valid:
                    removed.append(0)
                    runs.append(0)
                    kept.append(own.tobytes())
                    continue
                s, e = starts[r].values.to_numpy(zero_copy_only=False), stops[r].values.to_numpy(zero_copy_only=False)
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, e, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(
                runs, pa.int64()), pa.array(kept, pa.binary())], [*names, *OUTPUTS])

    fields = [T.StructField(c, T.LongType()) for c in OUTPUTS[:3]] + [T.StructField("kept", T.BinaryType())]
    return met.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES: dict[str, str] = {}
