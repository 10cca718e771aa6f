"""Operator 8: approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample (``SAMPLE`` rows, the least hashes of their ids); every row of the
table is then put into its leaf. Largest inner product becomes nearest point by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest length in the table (0 for queries). A query walks the tree through a
priority queue: the closest unexplored branch is opened next, so leaves come in order of promise. How many
leaves are visited is calibrated: ``CALIBRATION`` queries are also answered by brute force over all rows,
and the visits widen until their mean recall reaches the target. Scores of the rows in the visited leaves
are exact, summed in double precision in one fixed order, so equal vectors get equal scores.

Leaves travel as blocks of bounded size, so a leaf that holds a common vector many times splits. Defined
cases: vectors that are null, empty, zero or hold null or non-finite components take no part; a dimension
other than the most common one of the sample is not indexed; rows that repeat an id count each, but never
for a query of that id; an empty table gives no rows; fewer candidates than k give all that were found.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table
from .vectors import as_block, matrix, usable

SAMPLE, BRANCH, LEAF, CALIBRATION, TARGET = 20_000, 8, 256, 200, 0.97
BLOCK, QUERY_BLOCK, HELD, EXACT = 1024, 512, 100_000, 1 << 16
#: Stands where a query has fewer rows than k so far.
NOBODY = np.iinfo(np.int64).max
_FOUND = "query_id long, vec_id long, score double, leaf int"


class Tree:
    """Centres of a hierarchical k-means tree. ``children[i]`` are nodes, ``leaf[i]`` a leaf number or -1."""

    def __init__(self, points: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.leaves = [points.mean(axis=0)], [[]], [-1], 0
        open_ = [(0, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            part = self._split(points[rows], rng) if len(rows) > LEAF else None
            if part is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for c in np.unique(part):
                self.centres.append(points[rows[part == c]].mean(axis=0))
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centres) - 1)
                open_.append((len(self.centres) - 1, rows[part == c]))
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(x: np.ndarray, rng) -> np.ndarray | None:
        centres = x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
        for _ in range(10):
            part = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            centres = np.array([x[part == c].mean(axis=0) if (part == c).any() else centres[c] for c in range(len(centres))])
        return part if len(np.unique(part)) > 1 else None  # equal points stay together

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by way of the closest child at every node."""
        at, out = np.zeros(len(x), np.int64), np.full(len(x), -1)
        leaf = np.array(self.leaf)
        while (moving := np.flatnonzero(leaf[at] < 0)).size:
            for node in np.unique(at[moving]):
                rows, kids = moving[at[moving] == node], np.array(self.children[node])
                c = self.centres[kids]
                at[rows] = kids[((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)]
        out[:] = leaf[at]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                kids = self.children[node]
                far = ((self.centres[kids] - query) ** 2).sum(axis=1)
                near = int(far.argmin())
                for d, kid in zip(far.tolist(), kids, strict=True):
                    if kid != kids[near]:
                        heapq.heappush(queue, (d, kid))
                node = kids[near]
            out.append(self.leaf[node])
        return out


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest ** 2 - (x * x).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def _slack(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How far a matrix product of queries and rows can be off, as it sums in another order than the exact score."""
    return 1e-12 * (1 + np.sqrt((q * q).sum(axis=1) * (c * c).sum(axis=1).max(initial=0))) * q.shape[1]


class _Found:
    """The k best rows so far of each of a task's queries, best first, each with the leaf that it lies in."""

    def __init__(self, k: int):
        self.k, self.place = k, {}
        self.scores, self.ids, self.leaves = np.zeros((0, k)), np.zeros((0, k), np.int64), np.zeros((0, k), np.int32)

    def compare(self, qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, leaf: int, floor=-np.inf) -> None:
        """Queries meet the rows of one block: one matrix product, then exact scores for those rows only that
        reach the k-th score so far, and the score ``floor`` that k rows are known to reach."""
        at, rough = self._places(qi), q @ c.T
        own = qi[:, None] == ci
        rough[own] = -np.inf
        least = self.scores[at, -1]
        new = np.flatnonzero(least == -np.inf)
        if len(ci) > self.k and len(new):
            least[new] = np.partition(rough[new], len(ci) - self.k, axis=1)[:, len(ci) - self.k]
        i, j = np.nonzero(~own & ~(rough < np.maximum(least - _slack(q, c), floor)[:, None]))
        for lo in range(0, len(i), EXACT):
            a, b = i[lo:lo + EXACT], j[lo:lo + EXACT]
            self._take(at[a], ci[b], np.cumsum(c[b] * q[a], axis=1)[:, -1], leaf)  # one order of summation for all

    def _places(self, asked: np.ndarray) -> np.ndarray:
        at = np.array([self.place.setdefault(i, len(self.place)) for i in asked.tolist()], np.int64)
        more = len(self.place) - len(self.ids)
        if more:
            self.scores = np.vstack([self.scores, np.full((more, self.k), -np.inf)])
            self.ids = np.vstack([self.ids, np.full((more, self.k), NOBODY)])
            self.leaves = np.vstack([self.leaves, np.zeros((more, self.k), np.int32)])
        return at

    def _take(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray, leaf: int) -> None:
        some = np.unique(at)
        at = np.concatenate([np.repeat(some, self.k), at])
        scores = np.concatenate([self.scores[some].ravel(), scores])
        leaves = np.concatenate([self.leaves[some].ravel(), np.full(len(ids), leaf, np.int32)])
        ids = np.concatenate([self.ids[some].ravel(), ids])
        order = np.lexsort((ids, -scores, at))
        starts = np.searchsorted(at[order], some)
        top = order[starts[:, None] + np.arange(self.k)]
        self.scores[some], self.ids[some], self.leaves[some] = scores[top], ids[top], leaves[top]

    def rows(self) -> pa.RecordBatch:
        there = (self.ids != NOBODY) | (self.scores != -np.inf)
        asked = np.repeat(np.array(list(self.place), np.int64), there.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (asked, self.ids[there], self.scores[there], self.leaves[there])],
                                          ["query_id", "vec_id", "score", "leaf"])


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of every query among the rows that its task meets; a query's last component is the score below
    which no row counts. A task sends at most k rows for a query, however many blocks the query meets there; after ``HELD`` queries it sends what it has and starts anew."""

    def run(batches):
        found = _Found(k)
        for batch in batches:
            for row in batch.to_pylist():
                qi, q = as_block({"ids": row["q_ids"], "data": row["q_data"], "dim": row["dim"]})
                ci, c = as_block({"ids": row["c_ids"], "data": row["c_data"], "dim": row["dim"] - 1})
                found.compare(qi, q[:, :-1], ci, c, row["leaf"], q[:, -1])
                if len(found.ids) > HELD:
                    yield found.rows()
                    found = _Found(k)
        if len(found.ids):
            yield found.rows()

    return pairs.select("dim", "q_ids", "q_data", "c_ids", "c_data", "leaf").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def _by_leaf(df: DataFrame, rows: int, prefix: str) -> DataFrame:
    """``df`` (leaf, id, v) as blocks of one leaf each. A task packs what it holds of a leaf, so no leaf is
    gathered; a hash of the id spreads large leaves over tasks."""

    def run(batches):
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def block(leaf):
            ids, data = (np.concatenate(x) for x in zip(*held.pop(leaf), strict=True))
            sizes.pop(leaf)
            for lo in range(0, len(ids), rows):
                yield pa.RecordBatch.from_pydict({"leaf": pa.array([leaf], pa.int32()), "dim": pa.array([data.shape[1]], pa.int32()), "ids": pa.array(
                    [ids[lo:lo + rows].tobytes()], pa.binary()), "data": pa.array([data[lo:lo + rows].tobytes()], pa.binary())})

        for batch in batches:
            leaves, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "id"))
            if not len(ids):
                continue
            x = matrix(batch.column("v"))
            order = np.argsort(leaves, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
                leaf = int(leaves[at[0]])
                held.setdefault(leaf, []).append((ids[at], x[at]))
                sizes[leaf] = sizes.get(leaf, 0) + len(at)
                if sizes[leaf] >= rows:
                    yield from block(leaf)
        for leaf in list(held):
            yield from block(leaf)

    spread = df.select("leaf", "id", "v").repartition("leaf", F.pmod(F.xxhash64("id"), F.lit(4)))
    return spread.mapInArrow(run, "leaf int, dim int, ids binary, data binary").select(
        "leaf", "dim", F.col("ids").alias(f"{prefix}_ids"), F.col("data").alias(f"{prefix}_data"))


class Index:
    """Every row of ``rows`` (id, v) in its leaf."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        head = rows.select(F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h").alias("h")).first()["h"]
        sample = rows.filter(F.xxhash64("id") <= head).limit(2 * SAMPLE).toPandas() if head is not None else None
        self.tree = None
        if sample is None or not len(sample):
            return
        dims = sample["v"].map(len)
        self.dim = int(dims.mode()[0])
        lengths = rows.filter(F.size("v") == self.dim).agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m"))
        self.longest = lengths.first()["m"]
        sample = sample[dims == self.dim].sort_values("id")
        points = np.stack(sample["v"].to_numpy())
        self.tree = Tree(_lifted(points, self.longest))
        tree, longest = spark.sparkContext.broadcast(self.tree), self.longest

        def assign(batches):
            for batch in batches:
                x = matrix(batch.column("v"))
                leaves = tree.value.assign(_lifted(x, longest)) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), batch.column("id"), batch.column("v")], ["leaf", "id", "v"])

        self._tree = tree
        self.rows = rows.filter(F.size("v") == self.dim)
        placed = self.rows.select("id", "v").mapInArrow(assign, "leaf int, id long, v array<double>")
        self.blocks = saved(_by_leaf(placed, BLOCK, "c"))
        self.visits = self._calibrate(sample)
        self._sample = spark.sparkContext.broadcast(self._placed(sample["id"].to_numpy(np.int64)))

    def _calibrate(self, sample, k: int = 20) -> int:
        """The least number of leaves at which the mean recall of the calibration queries reaches TARGET:
        their true neighbours over all rows tell the leaves they must visit."""
        asked = sample.iloc[np.linspace(0, len(sample) - 1, min(CALIBRATION, len(sample))).astype(int)].drop_duplicates("id")
        q = np.stack(asked["v"].to_numpy())
        dim, q_ids, q_data = self.dim, asked["id"].to_numpy(np.int64).tobytes(), q.tobytes()
        # the k-th score among the sample's rows: no row below it is one of the k nearest, so no task sends it
        points = np.stack(sample["v"].to_numpy())
        known = q @ points.T
        known[asked["id"].to_numpy()[:, None] == sample["id"].to_numpy()] = -np.inf
        floor = np.full(len(q), -np.inf)
        if len(points) > k:
            floor = np.partition(known, len(points) - k, axis=1)[:, len(points) - k] - 2 * _slack(q, points)

        def brute(batches):
            block, best = as_block({"ids": q_ids, "data": q_data, "dim": dim}), _Found(k)
            for batch in batches:
                for row in batch.to_pylist():
                    best.compare(*block, *as_block({"ids": row["c_ids"], "data": row["c_data"], "dim": dim}), row["leaf"], floor)
            if len(best.ids):
                yield best.rows()

        found = self.blocks.mapInArrow(brute, _FOUND)
        true = _ranked(found, k).select("query_id", "leaf").toPandas()
        if not len(true):
            return self.tree.leaves
        rank = {}
        for i, x in zip(asked["id"], q, strict=True):
            point = np.append(x, 0.0)
            rank[i] = {leaf: r for r, leaf in enumerate(self.tree.visits(point, self.tree.leaves), 1)}
        needed = np.array([rank[i][leaf] for i, leaf in zip(true["query_id"], true["leaf"], strict=True)])
        share = np.array([(needed <= m).mean() for m in range(1, self.tree.leaves + 1)])
        return int(np.argmax(share >= TARGET)) + 1

    def _placed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaves, ids, points) of the sample's rows, as the index holds them."""
        wanted, dim = self.rows.sparkSession.sparkContext.broadcast(np.unique(ids)), self.dim

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    ci, c = as_block({"ids": row["c_ids"], "data": row["c_data"], "dim": dim})
                    some = np.isin(ci, wanted.value)
                    if some.any():
                        yield pa.RecordBatch.from_pydict({"leaf": pa.array([row["leaf"]], pa.int32()), "ids": pa.array(
                            [ci[some].tobytes()], pa.binary()), "data": pa.array([c[some].tobytes()], pa.binary())})

        found = [(row["leaf"], *as_block({"ids": row["ids"], "data": row["data"], "dim": dim})) for row in self.blocks.mapInArrow(
            run, "leaf int, ids binary, data binary").collect()]
        return (np.repeat([leaf for leaf, _, _ in found], [len(i) for _, i, _ in found]), np.concatenate([i for _, i, _ in found]),
                np.concatenate([x for _, _, x in found]))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """query_id, rank, vec_id, score of the ``k`` nearest found for every query (id, v)."""
        tree, visits, sample = self._tree, self.visits, self._sample

        def floors(ids, x, leaves):
            """The k-th score among the sample's rows in the leaves that a query visits: no row below it is one of
            the k nearest found, so no task sends it."""
            at, known, points = sample.value
            out = np.full(len(x), -np.inf)
            for lo in range(0, len(x) if len(points) > k else 0, 64):
                q = x[lo:lo + 64]
                scores, open_ = q @ points.T, np.zeros((len(q), tree.value.leaves), bool)
                for i, v in enumerate(leaves[lo:lo + 64]):
                    open_[i, v] = True
                scores[~open_[:, at] | (ids[lo:lo + 64, None] == known)] = -np.inf
                out[lo:lo + 64] = np.partition(scores, len(points) - k, axis=1)[:, len(points) - k] - 2 * _slack(q, points)
            return out

        def plan(batches):
            for batch in batches:
                x = matrix(batch.column("v"))
                leaves = [tree.value.visits(np.append(row, 0.0), visits) for row in x]
                if not leaves:
                    continue
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                x = np.hstack([x, floors(ids, x, leaves)[:, None]])  # the floor travels behind the vector
                for lo in range(0, len(x), 64):
                    some = leaves[lo:lo + 64]
                    at = np.repeat(np.arange(lo, lo + len(some)), [len(v) for v in some])
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(x[at].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([leaf for v in some for leaf in v], pa.int32()), pa.array(
                        ids[at]), v], ["leaf", "id", "v"])

        # a query row that repeats is asked once
        asked = queries.filter(F.size("v") == self.dim).select("id", "v").distinct().mapInArrow(plan, "leaf int, id long, v array<double>")
        # Spark takes the queries, dealt to all leaves they visit, for as small as they were before, and would broadcast them
        pairs = _by_leaf(asked, QUERY_BLOCK, "q").join(self.blocks.drop("dim").hint("merge"), "leaf")
        return _ranked(_nearest(pairs, k), k).select("query_id", "rank", "vec_id", "score")


def vectors(df: DataFrame) -> DataFrame:
    return df.filter(usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter("id is not null")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    index = Index(rows)
    if index.tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return index.search(rows.filter("id % 20 = 0"))


QUERIES = {"op8_ann": op8_ann}
ORACLES: dict[str, str] = {}
