"""Operator 10: resharding by minimum-cost flow (DataFrame functions; the flow itself is a small table).

Old shards have sizes, new shards have capacities. A unit of flow from an old shard to a new one moves a
byte, which costs 1, or nothing where it stays. The cheapest flow says how many bytes each old shard sends
where; the shard's rows, in a fixed order with the largest rows first, are then cut at those amounts, so that
what stays is the front and cuts fall among the smallest rows. Only shards that give or take are rewritten,
into a fresh folder; a layout (shard -> folder) says which folders hold the table, so that neither a retry nor
a lost driver doubles rows, and what the replaced folders hold stays whole until the caller drops them.

Running sums over a shard go through bins of the fixed order (size class, hash of the text), the texts of a bin
and 64 parts of a text, and no window holds a shard's rows. Rows with equal texts follow one another in that
order, so only a text that a cut meets lies in more than one shard: at most one text for each cut.

Defined cases: a null text has no bytes (size 16) and the CRC of the empty text; rows that repeat are placed
one by one; an empty table gives no rows; other columns pass through ``reshard``, those named like an output
column are replaced. A table without a layout is written whole. The law is ``bytes``: sizes are near equal, to within a row at each cut.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import saved, shared_dir, table

SHARDS, OLD = 40, 32
OUTPUTS = ("size", "text_crc32", "old_shard", "shard", "slot")
#: Where a row lies in the files read: its name between the placement and the rewrite.
ROW = ("_file", "_row")


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at the least cost, by successive cheapest paths over the small
    graph source -> old -> new -> sink. Supplies may exceed no capacity in total."""
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new shards can't hold the rows")
    if not supply:
        return {}
    heads, caps, costs, out = [], [], [], {}

    def edge(u, v, cap, cost):
        for a, b, c, w in ((u, v, cap, cost), (v, u, 0, -cost)):
            out.setdefault(a, []).append(len(heads))
            heads.append(b)
            caps.append(c)
            costs.append(w)

    for o, amount in supply.items():
        edge("s", ("o", o), amount, 0)
    for n, amount in capacity.items():
        edge(("n", n), "t", amount, 0)
    pairs = {}
    for o in supply:
        for n in capacity:
            pairs[o, n] = len(heads)
            edge(("o", o), ("n", n), sum(supply.values()), 0 if o == n else 1)
    height = dict.fromkeys(out, 0)
    while True:
        best, came, queue = {"s": 0}, {}, [(0, 0, "s")]
        tie = 0
        while queue:
            d, _, u = heapq.heappop(queue)
            if d > best[u]:
                continue
            for e in out[u]:
                v = heads[e]
                reach = d + costs[e] + height[u] - height[v]
                if caps[e] and reach < best.get(v, 1 << 62):
                    best[v], came[v], tie = reach, e, tie + 1
                    heapq.heappush(queue, (reach, tie, v))
        if "t" not in best:
            break
        for v in height:
            height[v] += best.get(v, max(best.values()))
        path, v = [], "t"
        while v != "s":
            path.append(came[v])
            v = heads[came[v] ^ 1]
        amount = min(caps[e] for e in path)
        for e in path:
            caps[e] -= amount
            caps[e ^ 1] += amount
    return {p: caps[e ^ 1] for p, e in pairs.items() if caps[e ^ 1]}


def capacities(total: int, shards: int) -> dict[int, int]:
    return {n: total * (n + 1) // shards - total * n // shards for n in range(shards)}


#: Bins of the fixed order: size classes an eighth of a power of two wide, largest first, then hashes of the text.
BINS = ["_size_class", "_high", "_low"]
#: Within a bin the texts follow one another; the rows of one text are parted by 64 hashes of the doc_id.
OF_TEXT = ["size", "text_crc32", "_part"]


def _order(size: Column, crc: Column, doc_id: Column) -> list[Column]:
    bins = (-F.floor(F.log2(size) * 8)).cast("int"), (crc % 64).cast("int"), (F.floor(crc / 64) % 64).cast("int")
    return [c.alias(n) for c, n in zip((*bins, F.pmod(F.xxhash64(doc_id), F.lit(64)).cast("int")), [*BINS, "_part"], strict=True)]


def _running(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row of its group: before its bin, before its
    part of a text in the bin, and before it in that part. Equal texts stay together, and still no window
    holds more than a group's bins, a bin's texts or the 64th part of a text's rows."""
    def before(keys: list[str], by: list[str], x: Column) -> Column:
        over = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(x).over(over), F.lit(0))

    parts = df.groupBy(*group, *BINS, *OF_TEXT).agg(F.sum(value).alias("_of_part"))
    bins = parts.groupBy(*group, *BINS).agg(F.sum("_of_part").alias("_of_bin"))
    bins = bins.select(*group, *BINS, before(group, BINS, F.col("_of_bin")).alias("_before_bin"))
    parts = parts.select(*group, *BINS, *OF_TEXT, before([*group, *BINS], OF_TEXT, F.col("_of_part")).alias("_before_part"))
    parts = parts.join(bins, [*group, *BINS]).select(*group, *BINS, *OF_TEXT, (F.col("_before_bin") + F.col("_before_part")).alias("_before"))
    rows = df.withColumn("_in_part", before([*group, *BINS, *OF_TEXT], order, value))
    rows = rows.join(parts, [*group, *BINS, *OF_TEXT]).withColumn(name, F.col("_before") + F.col("_in_part"))
    return rows.drop("_before", "_in_part")


def placed(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, old_shard) with shard and slot. Only a sum per old shard comes to
    the driver."""
    order = ["doc_id", *(c for c in ROW if c in rows.columns)]
    rows = saved(rows.select("*", *_order(F.col("size"), F.col("text_crc32"), F.col("doc_id"))))
    supply = {r["old_shard"]: r["n"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("n")).collect()}
    flow = min_cost_flow(supply, capacities(sum(supply.values()), shards))
    cuts, at = [], dict.fromkeys(supply, 0)
    for (o, n), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], -x[1], x[0][1])):
        cuts.append((o, n, at[o], at[o] + amount))
        at[o] += amount
    by_old: dict[int, list] = {}
    for o, n, lo, hi in cuts:
        by_old.setdefault(o, []).append((lo, hi, n))
    lines = [(o, [{"lo": lo, "hi": hi, "n": n} for lo, hi, n in c]) for o, c in by_old.items()]
    plan = rows.sparkSession.createDataFrame(lines, "old_shard int, cuts array<struct<lo:long,hi:long,n:int>>")
    rows = _running(rows, ["old_shard"], order, F.col("size"), "_start")
    # a row goes where its middle lies
    middle = F.col("_start") + F.floor(F.col("size") / 2)
    hit = F.filter("cuts", lambda c: (c["lo"] <= middle) & (middle < c["hi"]))
    rows = rows.join(F.broadcast(plan), "old_shard").withColumn("shard", hit[0]["n"]).drop("cuts", "_start")
    # slots: the old shards of a shard follow one another
    taken = rows.groupBy("shard", "old_shard").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("old_shard").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.select("shard", "old_shard", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    rows = _running(rows, ["shard", "old_shard"], order, F.lit(1), "slot").join(taken, ["shard", "old_shard"])
    return rows.withColumn("slot", F.col("slot") + F.col("_ahead")).drop("_ahead", "_part", *BINS)


def sized(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.drop(*OUTPUTS).select("*", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def reshard(df: DataFrame, old_shard: Column, shards: int = SHARDS) -> DataFrame:
    """``df`` (doc_id, text, ...) in ``shards`` new shards; ``old_shard`` says where each row lies now."""
    rows = sized(df.select("*", old_shard.cast("int").alias("_at"))).withColumnRenamed("_at", "old_shard")
    own = ["doc_id", "size", "text_crc32", "old_shard"]
    rest = [c for c in rows.columns if c not in own]  # travels in one column, so that no name meets a working column
    out = placed(rows.select(*own, F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest")), shards)
    return out.select(*own, "shard", "slot", "_rest.*").select(*(f"`{c}`" for c in rows.columns), "shard", "slot")


def affected(rows: DataFrame) -> DataFrame:
    """Shards that give or take rows: the ones whose files must be written again."""
    moved = rows.filter("shard <> old_shard")
    return moved.select("shard").union(moved.select("old_shard")).distinct()


def keyed(files: DataFrame) -> DataFrame:
    """``files`` (a plain read of Parquet files) with the name of each row."""
    return files.select("*", F.col("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))


def rewrite(source: DataFrame, rows: DataFrame, layout: dict[int, str], path: str) -> dict[int, str]:
    """The new layout of a table (``source``, keyed) whose rows are placed as ``rows`` says (keyed, with old_shard,
    shard and slot). Every affected shard, and every shard that ``layout`` has no folder for, is written whole to a
    fresh folder of ``path``; the others keep their folder, and a shard without rows has none. The layout is also
    written, last, to the fresh folder's ``_layout``. Only names of shards come to the driver."""
    spark = rows.sparkSession
    rows = saved(rows)
    changed = {r["shard"] for r in affected(rows).collect()}
    holding = {r["shard"] for r in rows.select("shard").distinct().collect()}
    kept = {n: layout[n] for n in holding - changed if n in layout}
    anew = sorted(holding - set(kept))
    folder = f"{path}/reshard-{uuid.uuid4().hex}"
    if anew:
        some = rows.filter(F.col("shard").isin(anew)).select(*ROW, "size", "text_crc32", F.col("shard").cast("int"), F.col("slot").cast("long"))
        # the join's tasks write their rows of every shard: texts are shuffled once, not a second time by shard
        (source.drop(*OUTPUTS).join(some, list(ROW)).drop(*ROW).withColumn("part", F.col("shard"))
         .sortWithinPartitions("part", "slot").write.partitionBy("part").parquet(folder, compression="zstd"))
    new = kept | {n: f"{folder}/part={n}" for n in anew}
    spark.createDataFrame(sorted(new.items()), "shard int, folder string").coalesce(1).write.parquet(f"{folder}/_layout")
    return new


def stored(spark: SparkSession, layout: dict[int, str], schema: StructType) -> DataFrame:
    """The rows of a layout: ``schema`` (the source's columns) with size, text_crc32, shard and slot."""
    for name, kind in (("size", LongType()), ("text_crc32", LongType()), ("shard", IntegerType()), ("slot", LongType())):
        schema = StructType([f for f in schema if f.name not in (name, *ROW)]).add(name, kind)
    if not layout:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(layout[n] for n in sorted(layout)))


def op10_resharding(spark, sf_dir: str) -> DataFrame:
    source = keyed(table(spark, sf_dir, "documents"))
    # the table has no shards yet: its first layout is by text, so that equal texts start together
    first = F.pmod(F.xxhash64("text_crc32"), F.lit(OLD)).cast("int").alias("old_shard")
    rows = placed(sized(source.select("doc_id", "text", *ROW)).drop("text").select("*", first))
    layout = rewrite(source, rows, {}, shared_dir(spark))
    return stored(spark, layout, source.schema).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                                       F.lit(None).cast("int").alias("grown_shard"), first)


QUERIES = {"op10_resharding": op10_resharding}
ORACLES: dict[str, str] = {}
