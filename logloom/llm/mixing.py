"""Operator 1: mixing sources to target weights (DataFrame functions only).

Token shares p of the sources become weights p**a / sum(p**a). The exponent a is found by bisection: the
entropy of the weights falls as a rises to 1, the repetition of the rarest source falls too. The larger of
the two exponents that meet the entropy target and the repetition limit is taken. The weights, in parts per
million, give each source a budget of tokens. A source is dealt into blocks by the leading bits of a hash of
doc_id; every epoch takes the blocks in another hashed order, and the budget ends inside one block of the
last epoch, so that no source is ever sorted or summed in one task.

The mixture as rows: every document once for each epoch that takes it, with ``epoch``, ``block`` and
``block_start``, the tokens of its source before that block in that epoch. Ordering by
(epoch + block_start / source tokens) / (budget / source tokens) interleaves the sources at their weights.

Defined cases: a null source is a source of its own; texts without words (null ones too) have no tokens
and are taken once, in epoch 0; a document of a source is taken in the last, partial epoch if it begins
before the budget's end; repeated rows are mixed one by one; an empty table gives an empty mixture; other
columns pass through, those named like an output column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

BLOCKS = 4096
OUTPUTS = ("epoch", "block", "block_start", "n_tokens", "weight_ppm")
#: Levels of the bisection; each job settles ``STEP`` of them.
LEVELS, STEP = 30, 5


def n_tokens(text):
    """Words: runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))


def _bisect(sources: DataFrame, too_low, levels: int = LEVELS) -> float:
    """The exponent in [0, 1] where ``too_low`` turns false, by bisection. A job sums the powers of the shares
    for all midpoints that the next ``STEP`` levels can reach; only those sums come to the driver."""
    low, high = 0.0, 1.0
    for _ in range(0, levels, STEP):
        step = (high - low) / (1 << STEP)
        points = [low + i * step for i in range((1 << STEP) + 1)]
        p, sums = F.col("share"), []
        for i, a in enumerate(points):
            power = F.pow(p, F.lit(a))
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(p)).alias(f"s{i}"), F.max(power / p).alias(f"m{i}")]
        row = sources.agg(*sums).first()
        left, right = 0, 1 << STEP
        while right - left > 1:
            mid = (left + right) // 2
            if too_low(points[mid], row[f"z{mid}"], row[f"s{mid}"], row[f"m{mid}"]):
                left = mid
            else:
                right = mid
        low, high = points[left], points[right]
    return high


def exponent(totals: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The least exponent with an entropy of at most ``target_entropy`` (a part of the largest one, that of
    equal weights) and at most ``max_repeats`` epochs of any source when the largest share is used once."""
    live = totals.filter("tokens > 0")
    whole = live.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not whole["n"] or whole["n"] == 1:
        return 1.0
    shares = live.select((F.col("tokens") / F.lit(whole["t"]).cast("double")).alias("share"))
    most = shares.agg(F.max("share").alias("x")).first()["x"]
    found = 0.0
    if target_entropy is not None:
        goal = target_entropy * math.log(whole["n"])
        found = _bisect(shares, lambda a, z, s, m: math.log(z) - a * s / z > goal)
    if max_repeats is not None:
        # with the most used source taken once, a source is taken (w/p) / (w_top/p_top) times
        found = max(found, _bisect(shares, lambda a, z, s, m: m * most ** (1 - a) > max_repeats))
    return found


def mixture(df: DataFrame, target_entropy: float | None = 0.98, max_repeats: float | None = 2.0,
            budget: int | None = None, seed: int = 17) -> DataFrame:
    """``df`` (doc_id, source, text, ...) mixed. ``budget``: tokens of the mixture; left out, it is the least
    that takes every document at least once, so that mixing repeats and never drops."""
    docs = df.drop(*OUTPUTS).withColumn("n_tokens", n_tokens(F.col("text")))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    blocks = saved(docs.groupBy("source", F.shiftrightunsigned(key, 52).cast("int").alias("bin"))
                   .agg(F.sum("n_tokens").alias("tokens")))
    totals = saved(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    a = exponent(totals, target_entropy, max_repeats)
    powers = totals.withColumn("power", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))))
    sums = powers.agg(F.sum("power").alias("z"), F.max(F.col("tokens") / F.col("power")).alias("least")).first()
    z = sums["z"] or 1.0
    whole = budget if budget is not None else math.ceil((sums["least"] or 0.0) * z)
    w = powers.select("source", F.col("tokens").alias("source_tokens"),
                      F.coalesce(F.round(F.col("power") / F.lit(z) * 1e6).cast("long"), F.lit(0)).alias("weight_ppm"),
                      F.coalesce(F.ceil(F.round(F.lit(float(whole)) * F.col("power") / F.lit(z), 3)), F.lit(0)).alias("quota"))
    w = w.withColumn("full", F.when(F.col("source_tokens") > 0, F.floor(F.col("quota") / F.col("source_tokens"))).otherwise(1))
    # one row per source, block and epoch: at most BLOCKS of them in a window
    taken = (blocks.join(w, blocks["source"].eqNullSafe(w["source"])).drop(w["source"])
             .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full").cast("int"))))
             .withColumn("order", F.xxhash64(F.lit(seed), "epoch", "bin")))
    before = Window.partitionBy("source", "epoch").orderBy("order", "bin").rowsBetween(Window.unboundedPreceding, -1)
    taken = (taken.withColumn("block_start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
             .withColumn("block", F.row_number().over(Window.partitionBy("source", "epoch").orderBy("order", "bin")) - 1)
             .withColumn("left", F.col("quota") - F.col("epoch") * F.col("source_tokens") - F.col("block_start"))
             .withColumn("whole", (F.col("epoch") < F.col("full")) | (F.col("left") >= F.col("tokens")) & (F.col("tokens") > 0))
             .filter("whole or left > 0 and tokens > 0"))
    keyed = docs.withColumn("bin", F.shiftrightunsigned(key, 52).cast("int")).withColumn("key", key)
    out = [*docs.columns, "epoch", "block", "block_start", "weight_ppm"]
    # whole blocks: every block's epochs as one list, so that a document meets one row
    plan = taken.groupBy("source", "bin").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "block", "block_start", "weight_ppm", "whole", "left"))).alias("plan"))
    plan = plan.select(F.col("source").alias("plan_source"), F.col("bin").alias("plan_bin"), "plan")
    met = keyed.join(plan, keyed["source"].eqNullSafe(plan["plan_source"]) & (keyed["bin"] == plan["plan_bin"]))
    copies = met.withColumn("p", F.explode("plan")).select(
        "*", "p.epoch", "p.block", "p.block_start", "p.weight_ppm", "p.whole", "p.left").filter("n_tokens > 0 or epoch = 0")
    # the block in which a budget ends: its documents in hashed order, until the rest is used up
    inside = Window.partitionBy("source", "bin", "epoch").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = (copies.filter("not whole").withColumn("used", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
           .filter("used < left"))
    return copies.filter("whole").select(*out).unionByName(cut.select(*out))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(docs).drop("text").select("doc_id", "source", "n_tokens", "epoch", "block", "block_start", "weight_ppm")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
