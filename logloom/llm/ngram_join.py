"""Operator 3: Jaccard join on word n-grams, with prefix, length, positional and suffix filters.

A document's set is its distinct shingles of ``k`` words (64-bit hashes). All shingles are ordered rare first:
those of a single document, then by frequencies counted over the whole table in 2**18 cells, ties by hash. Two sets of similarity t share an
element among their first n - ceil(t n) + 1, so documents meet on those prefixes only. Candidates pass the
length filter, the positional filter (shared prefix elements plus what can follow them; elements that
no other prefix holds count for nobody) and the suffix filter
(sizes of the sets in 32 fixed parts of the hash range bound their distance from below), which across components is preceded by a cheaper bound of the same kind (bitmaps of
the parities of 1,024 hash cells: every element that one set holds alone turns one bit); then the sets are compared,
once for a pair.

No group is expanded into all its pairs. Equal sets form one class and meet as one. First, each prefix
element has a leader, a class is compared with the leader that it shares most elements with, and components
of the links that hold are formed (twice, with other leaders). A pair inside a component can't change the components any more, so second, only classes of different components meet, those
outside an element's most common component against all others. Every link between different components is
found that way, so reachability is exact. Where links are asked for, each component is dealt into blocks of
bounded size and every two blocks meet in one task, which counts all their intersections in matrix products: the work grows
with the pairs of a component, as their links may, but the rows only with its classes and blocks.

Defined cases: ASCII letters are lower-cased and words are runs of bytes other than ASCII white space; a text
with fewer than ``k`` words is one shingle; a text without words, or null, has an empty set and links with
nothing; repeated rows are one class; a null doc_id is never the least of a component unless alone; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, release, saved, table, text_bytes
from .components import components

CELL_BITS, KEY_BITS, SEEN_BITS, PARTS, FILTER_BITS, CHUNK, SKETCH = 18, 36, 27, 32, 24, 1 << 20, 1024
#: About how many classes and elements a block of a component has, and how many elements a matrix product takes.
BLOCK_CLASSES, BLOCK_ELEMENTS, COLUMNS = 512, 400_000, 2048
#: Rounds in which a class meets the likeliest of its elements' leaders, before the rest is compared.
ROUNDS = 2

#: What two classes that meet at an element can share at most: those up to it that other prefixes hold too, and those behind it.
_MOST = "least(a.pos - a.own, b.pos - b.own) + 1 + least(a.n - a.pos - 1, b.n - b.pos - 1)"

_RANDOM = np.random.default_rng(20_011)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
_STEP, _PLACE = np.uint64(0x9E3779B97F4A7C15), _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _apart(a: str, b: str) -> str:
    """The SQL of the suffix filter's distance: the sum over the parts of what their sizes differ by."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)"


def _turned(a: str, b: str) -> str:
    """The SQL of the bits that differ between two sketches, at most the number of elements that one set holds alone."""
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH // 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in text order, bounds of each document's hashes)."""
    n = len(bounds) - 1
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    blank = _SPACE[data]
    before = np.concatenate([[True], blank[:-1]]) if len(data) else blank
    starts = np.flatnonzero(~blank & (before | first[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    lo = starts[0]
    place = np.arange(lo, len(data), dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.cumprod(np.full(int(place.max()) + 1, _STEP))
    words = _mix(np.add.reduceat(_VALUE[data[lo:]] * powers[place], starts - lo))
    word_bounds = np.searchsorted(starts, bounds)
    sizes = np.diff(word_bounds)
    counts = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(word_bounds[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    few = np.repeat(sizes < k, counts)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    out = np.repeat(np.minimum(sizes, k), counts).astype(np.uint64)
    length = np.repeat(sizes, counts)
    for j in range(k):
        out += np.where(~few | (j < length), padded[at + j] * _PLACE[j], np.uint64(0))
    return _mix(out), ends


def _each(batch: pa.RecordBatch, k: int):
    """(row number, sorted distinct hashes) of every document of a batch."""
    data, bounds = text_bytes(batch.column("text"))
    for i, j in chunks(bounds, CHUNK):
        hashes, ends = shingles(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], k)
        for r in range(i, j):
            x = np.sort(hashes[ends[r - i]:ends[r - i + 1]])
            yield r, x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _class_of(x: np.ndarray) -> int:
    """The 64-bit name of a set (two sums over its elements and its size)."""
    sums = np.array([x.sum(), _mix(x).sum(), len(x)], np.uint64)
    return int(_mix((sums * _PLACE[:3]).sum(keepdims=True)).view(np.int64)[0])


def _coded(keys: np.ndarray) -> bytes:
    """Sorted keys as 16-bit gaps; a gap of 65535 or more takes fillers of 65535 first."""
    gaps = np.diff(keys, prepend=keys[:0].dtype.type(0))
    fill = (gaps // 65535).astype(np.int64)
    out = np.full(len(keys) + int(fill.sum()), 65535, np.uint16)
    out[np.cumsum(fill + 1) - 1] = gaps % 65535
    return out.tobytes()


def _decoded(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 65535]


def frequencies(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of the shingles that several documents hold, logarithm of the number of shingles (0 to 120) in
    each of the 2**CELL_BITS cells of the hash range), over all documents. Shingles move as sorted lists of
    KEY_BITS bits, a range of hashes at a time; what comes back has a fixed size. Shingles that fall together
    make the order less fine, never the join less exact."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = min(max(6, (4 * partitions - 1).bit_length()), CELL_BITS)
    width = np.uint64(KEY_BITS - range_bits)

    def keys(batches):
        release()
        held, size = [], 0

        def send():
            x = np.concatenate(held)
            held.clear()
            x.sort()
            x >>= np.uint64(64 - KEY_BITS)
            cut = np.searchsorted(x, np.arange((1 << range_bits) + 1).astype(np.uint64) << width)
            some = np.flatnonzero(np.diff(cut))
            x &= np.uint64((1 << int(width)) - 1)
            inside = x.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(
                [_coded(inside[cut[r]:cut[r + 1]]) for r in some], pa.binary())], ["range", "keys"])

        for batch in batches:
            for _, x in _each(batch, k):
                held.append(x)
                size += len(x)
                if size > 4_000_000:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r, data in zip(batch.column("range").to_pylist(), batch.column("keys"), strict=True):
                held.setdefault(r, []).append(_decoded(data.as_py()))
        for r, parts in held.items():
            x = np.sort(np.concatenate(parts))
            many = x[1:][x[1:] == x[:-1]]
            bits = np.zeros(1 << (SEEN_BITS - range_bits), bool)
            bits[many >> (KEY_BITS - SEEN_BITS)] = True
            cells = np.bincount(x >> (KEY_BITS - CELL_BITS), minlength=1 << (CELL_BITS - range_bits))
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "bits": [np.packbits(bits).tobytes()],
                                              "cells": [np.minimum(np.log2(cells + 1) * 4, 120).astype(np.uint8).tobytes()]})

    found = (docs.select("text").mapInArrow(keys, "range int, keys binary").repartition("range")
             .mapInArrow(count, "range int, bits binary, cells binary").collect())
    bitmap, cells = np.zeros(1 << (SEEN_BITS - 3), np.uint8), np.zeros(1 << CELL_BITS, np.uint8)
    for row in found:
        for whole, part in ((bitmap, row["bits"]), (cells, row["cells"])):
            n = len(whole) >> range_bits
            whole[row["range"] * n:(row["range"] + 1) * n] = np.frombuffer(part, np.uint8)
    return bitmap, cells


def _ranks(x: np.ndarray, bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The sorted order keys of a set's hashes: those of one document first, then by frequency, then by hash."""
    bit = (x >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
    seen = (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
    rank = np.where(seen, cells[(x >> np.uint64(64 - CELL_BITS)).astype(np.int64)] + 1, 0).astype(np.uint64)
    return np.sort((rank << np.uint64(56)) | (x >> np.uint64(8)))


def _sets(docs: DataFrame, k: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, class and, for the first document of a class in a task, its prefix, part sizes and sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        release()
        seen = set()
        for batch in batches:
            rows, sizes, names, firsts, prefixes, parts, sketches = [], [], [], [], [], [], []
            for r, x in _each(batch, k):
                rows.append(r)
                sizes.append(len(x))
                name = _class_of(x) if len(x) else None
                names.append(name)
                if name is None or name in seen:
                    firsts.append(None)
                    prefixes.append(None)
                    parts.append(None)
                    sketches.append(None)
                    continue
                seen.add(name)
                keys = _ranks(x, *shared.value)[:len(x) - -(-percent * len(x) // 100) + 1]
                # elements of one document alone have nobody to meet; they come first and keep their places
                alone = int(np.searchsorted(keys, np.uint64(1 << 56)))
                firsts.append(alone)
                prefixes.append(keys[alone:].view(np.int64))
                parts.append(np.bincount((x >> np.uint64(59)).astype(np.int64), minlength=PARTS).astype(np.int32))
                odd = np.bincount((x & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
                sketches.append(np.packbits(odd.astype(bool)).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(names, pa.int64()), pa.array(
                    firsts, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32())), pa.array(
                    sketches, pa.list_(pa.int64()))], ["doc_id", "n", "class", "skipped", "prefix", "parts", "sketch"])

    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n int, class long, skipped int, prefix array<long>, parts array<int>, sketch array<long>"))
    shared.destroy()  # the rows are in files now; a session that runs many joins keeps none of their tables
    return rows


def _elements(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """class, set (array<long>) of the classes in ``wanted``, as a written table: a filter of fixed size says
    which documents' sets leave their task, one for a class in a task."""
    bits = wanted.select(F.pmod("class", F.lit(1 << FILTER_BITS)).alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("x")).toPandas()
    table_ = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    table_[bits["w"]] = bits["x"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table_)

    def run(batches):
        release()
        seen, mask = set(), (1 << FILTER_BITS) - 1
        for batch in batches:
            names, sets = [], []
            for _, x in _each(batch, k):
                if not len(x):
                    continue
                name = _class_of(x)
                b = name & mask
                if name not in seen and shared.value[b >> 5] >> (b & 31) & 1:
                    seen.add(name)
                    names.append(name)
                    sets.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["class", "set"])

    found = docs.select("text").mapInArrow(run, "class long, set array<long>")
    found = saved(found.join(wanted, "class", "left_semi").dropDuplicates(["class"]), "uncompressed")
    shared.destroy()
    return found


def _linked(blocks: pa.Table, percent: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Class names of two blocks of a component (or of one, if it meets itself), and the places among them of the
    two ends of every link between the blocks (or within the one)."""
    names, b = blocks.column("class").to_numpy(), blocks.column("b").to_numpy()
    sets = blocks.column("set").combine_chunks()
    sizes = np.diff(sets.offsets.to_numpy()).astype(np.int64)
    of, flat = np.repeat(np.arange(len(names)), sizes), sets.flatten().to_numpy()
    one = blocks.column("i")[0].as_py() == blocks.column("j")[0].as_py()
    left = np.flatnonzero(b == b[0])
    right = left if one else np.flatnonzero(b != b[0])
    if one:
        values, place, held = np.unique(flat, return_inverse=True, return_counts=True)
        common = held > 1
    else:
        values, place = np.unique(flat, return_inverse=True)
        mine = b[of] == b[0]
        common = (np.bincount(place[mine], minlength=len(values)) > 0) & (np.bincount(place[~mine], minlength=len(values)) > 0)
    column = np.where(common, np.cumsum(common) - 1, -1)[place]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0):]
    column, of = column[order], of[order]
    shared = np.zeros((len(left), len(right)), np.int64)
    # counts are exact: a product adds COLUMNS ones at most
    for lo in range(0, int(common.sum()), COLUMNS):
        some = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
        bits = np.zeros((len(names), COLUMNS), np.float32)
        bits[of[some], column[some] - lo] = 1
        shared += (bits[left] @ bits[right].T).astype(np.int64)
    link = 100 * shared >= percent * (sizes[left][:, None] + sizes[right] - shared)
    x, y = np.nonzero(np.triu(link, 1) if one else link)
    return names, (left[x], right[y])


class Join:
    """The join of one table; see the module's text for the steps."""

    def __init__(self, docs: DataFrame, k: int = 4, percent: int = 85):
        self.k, self.percent = k, percent
        self.docs = docs.select("doc_id", "text")

    def _near(self, a: str = "a", b: str = "b", shared="") -> str:
        """The length filter, or with ``shared`` (an SQL bound of the intersection) the whole condition."""
        if not shared:
            return f"100 * least({a}.n, {b}.n) >= {self.percent} * greatest({a}.n, {b}.n)"
        return f"100 * ({shared}) >= {self.percent} * ({a}.n + {b}.n - ({shared}))"

    def _filtered(self, met: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs from single meetings (a, b: class, n, pos): the positional filter over all shared prefix
        elements, then the suffix filter."""
        pairs = met.groupBy("a.class", "b.class").agg(F.first("a.n").alias("an"), F.first("b.n").alias("bn"), F.count("*").alias(
            "c"), F.max("a.pos").alias("ap"), F.max("b.pos").alias("bp")).toDF("a", "b", "an", "bn", "c", "ap", "bp")
        bound = "(c + least(an - ap - 1, bn - bp - 1))"
        near = lambda x: f"100 * ({x}) >= {self.percent} * (an + bn - ({x}))"
        pairs = pairs.filter(near(bound)).select("a", "b", "an", "bn", "c")
        parts = known.select(F.col("class").alias("a"), F.col("parts").alias("a_parts"))
        pairs = pairs.join(parts, "a").join(parts.toDF("b", "b_parts"), "b")
        return pairs.filter(near(f"(an + bn - {_apart('a_parts', 'b_parts')}) / 2")).select("a", "b", "an", "bn", "c")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        sets = _elements(self.docs, self.k, ends)
        both = pairs.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
        same = both.withColumn("i", F.size(F.array_intersect("a_set", "b_set")))
        return same.filter(f"100 * i >= {self.percent} * (an + bn - i)").select("a", "b")

    def _sided(self, posts: DataFrame, roots: DataFrame | None) -> DataFrame:
        """``posts`` with the root of each class's component."""
        if roots is None:
            return posts.withColumn("root", F.col("s.class"))
        roots = roots.toDF("class", "root")
        return posts.join(roots, posts["s.class"] == roots["class"], "left").select("key", "s", F.coalesce("root", "s.class").alias("root"))

    def _blocks(self, roots: DataFrame) -> DataFrame:
        """root, i, j, b, class, set: the blocks i <= j of each component that meet, with the classes of both."""
        members = _elements(self.docs, self.k, roots.select(F.col("node").alias("class"))).join(roots.toDF("class", "root"), "class")
        blocks = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum(F.size("set")) / BLOCK_ELEMENTS)).alias("q"))
        dealt = members.join(blocks, "root").withColumn("b", F.expr("pmod(xxhash64(class), q)"))
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
        return dealt.select("root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "class", "set")

    def run(self, links: bool = False) -> DataFrame:
        """doc_id, n_shingles, component_id for every row; with ``links`` also class (the name of the row's set,
        null where it is empty) and links (how many other sets link with it)."""
        rows, roots = self._joined()
        of_class = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")).join(
            roots.toDF("class", "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        named = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
        named = of_class.join(named, "root").select("class", "component_id")
        out = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
        if links:
            percent = self.percent

            def count(blocks: pa.Table) -> pa.Table:
                names, (a, b) = _linked(blocks, percent)
                ends = np.bincount(np.concatenate([a, b]), minlength=len(names))
                return pa.table({"class": pa.array(names, pa.int64()), "links": pa.array(ends, pa.int64())})

            ends = self._blocks(roots).groupBy("root", "i", "j").applyInArrow(count, "class long, links long")
            named = named.join(ends.groupBy("class").agg(F.sum("links").alias("links")), "class", "left")
            out += ["class", F.when(F.col("class").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("links")]
        return rows.join(named, "class", "left").select(*out)

    def links(self) -> DataFrame:
        """a, b: every pair of different classes that link, once, with a < b."""
        percent = self.percent

        def pairs(blocks: pa.Table) -> pa.Table:
            names, (a, b) = _linked(blocks, percent)
            return pa.table({"a": pa.array(np.minimum(names[a], names[b]), pa.int64()), "b": pa.array(np.maximum(names[a], names[b]), pa.int64())})

        return self._blocks(self._joined()[1]).groupBy("root", "i", "j").applyInArrow(pairs, "a long, b long")

    def _joined(self) -> tuple[DataFrame, DataFrame]:
        """Rows with their class, and (node, root) of the classes that link with any."""
        rows = _sets(self.docs, self.k, self.percent, frequencies(self.docs, self.k))
        met = rows.filter("size(prefix) > 0")
        posts = met.select("class", "n", F.posexplode("prefix").alias("at", "key"), "skipped").select(
            "key", F.struct("class", "n", (F.col("at") + F.col("skipped")).alias("pos")).alias("s"))
        # elements that several classes hold (tasks of their own may have sent the same class)
        # all three steps go by the key, so postings are shuffled once for them
        posts = posts.repartition("key").distinct()
        held = posts.groupBy("key").agg(F.min("s.class").alias("x"), F.max("s.class").alias("y")).filter("x < y").select("key")
        posts = posts.join(held, "key", "left_semi")
        # what stands before an element and is in no other prefix is shared with nobody met there: own counts it
        before = F.row_number().over(Window.partitionBy("s.class").orderBy("s.pos"))
        posts = saved(posts.withColumn("s", F.struct("s.class", "s.n", "s.pos", (F.col("s.pos") + 1 - before).alias("own"))))
        known = saved(met.select("class", "parts", "sketch").join(posts.select("s.class").distinct(), "class", "left_semi").dropDuplicates(["class"]))
        links = tested = roots = None
        for turn in range(ROUNDS):
            side = self._sided(posts, roots)
            # first the class with the smallest share of elements of its own (the middle of a group of near copies), then any
            middle = F.col("s.own") / F.col("s.n") if turn == 0 else F.lit(0.0)
            heads = side.groupBy("key").agg(F.min_by(F.struct("s", "root"), F.struct(middle, F.xxhash64("s.class", F.lit(turn)))).alias("h"))
            pairs = side.join(heads, "key").filter("root <> h.root").select(F.col("h.s").alias("a"), F.col("s").alias("b"))
            pairs = self._filtered(pairs.filter(self._near()).filter(self._near(shared=_MOST)), known)
            # a class meets one leader in a round, the one it shares most elements with
            pairs = pairs.groupBy("b").agg(F.max_by(F.struct("a", "an", "bn"), F.struct("c", "a")).alias("p")).select(
                F.least("p.a", "b").alias("a"), F.greatest("p.a", "b").alias("b"), F.when(F.expr("p.a < b"), F.col("p.an")).otherwise(
                    F.col("p.bn")).alias("an"), F.when(F.expr("p.a < b"), F.col("p.bn")).otherwise(F.col("p.an")).alias("bn"))
            pairs = saved(pairs.distinct())
            good = saved(self._verified(pairs))
            links, tested = (good, pairs) if links is None else (links.union(good), tested.union(pairs))
            roots = saved(components(links))
        # meetings across components: those outside an element's most common component with all others
        side = saved(self._sided(posts, roots))
        most = side.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
            F.max_by("root", F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).filter("roots > 1").select("key", "most")
        # the sketches travel along here, so that a pair that they rule out leaves no row
        open_ = saved(side.join(most, "key").join(known, F.col("s.class") == known["class"]).select("key", "root", "most", F.col(
            "s").withField("sketch", F.col("sketch")).alias("s")))
        left = open_.filter("root <> most").select("key", F.col("root").alias("a_root"), F.col("s").alias("a"))
        right = open_.select("key", F.col("root").alias("b_root"), "most", F.col("s").alias("b"))
        met = left.join(right, "key").filter("a_root <> b_root and (b_root = most or a.class < b.class)").filter(self._near())
        met = met.filter(self._near(shared=_MOST)).filter(self._near(shared=f"(a.n + b.n - ({_turned('a.sketch', 'b.sketch')})) / 2"))
        turned = F.expr("a.class < b.class")
        met = met.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("b"))
        last = saved(self._filtered(met, known).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        return rows, saved(components(links.union(saved(self._verified(last)))))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return Join(table(spark, sf_dir, "documents")).run(links=True)


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLES: dict[str, str] = {}
