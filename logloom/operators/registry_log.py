"""Parser registry as an append-only log of versions, and reports over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import FINGERPRINTS, TOKENIZERS
from .dlq import latest

# log columns: source_id, seq BIGINT, version STRING, action STRING
# action is 'promote', 'rollback' (the newest live version is withdrawn) or anything else (ignored)


def live_versions(log: DataFrame) -> DataFrame:
    """Promoted versions that no later rollback withdrew, newest first (``rank`` 1 = current).

    Each rollback withdraws the newest version still standing, so a promotion
    survives when fewer rollbacks than promotions follow it: the running balance
    from the end of the log never has to look at more than one source.
    """
    after = Window.partitionBy("source_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("action") == "rollback", 1).when(F.col("action") == "promote", -1).otherwise(0)
    walked = log.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(after)).withColumn(
        "_high", F.min("_sum").over(after.rowsBetween(Window.unboundedPreceding, -1)))
    # a promotion stands when it lowers the running minimum below every earlier value
    stands = walked.filter("action = 'promote' AND _sum < least(coalesce(_high, 0), 0)")
    ranked = Window.partitionBy("source_id").orderBy(F.desc("seq"))
    return stands.withColumn("rank", F.row_number().over(ranked)).select("source_id", "seq", "version", "rank")


def current(log: DataFrame) -> DataFrame:
    return live_versions(log).filter("rank = 1").drop("rank")


def previous(log: DataFrame) -> DataFrame:
    """What a rollback would restore; a source without a row would be retired."""
    return live_versions(log).filter("rank = 2").drop("rank")


def bump_sql(version: str) -> str:
    return (f"CASE WHEN {version} RLIKE '^v[0-9]+$' THEN concat('v', CAST(substr({version}, 2) AS BIGINT) + 1)"
            f" ELSE concat({version}, '.1') END")


def promoted_version(proposed: str, live: str) -> str:
    """Version a promotion gets: the live one plus one unless the proposal is higher."""
    def num(v: str) -> str:
        return f"CASE WHEN {v} RLIKE '^v[0-9]+$' THEN CAST(substr({v}, 2) AS BIGINT) ELSE 0 END"

    return (f"CASE WHEN {live} IS NULL THEN coalesce({proposed}, 'v1')"
            f" WHEN {num(proposed)} <= {num(live)} THEN {bump_sql(live)} ELSE {proposed} END")


def overlay(live: DataFrame, candidates: DataFrame) -> DataFrame:
    """Live parsers with the candidates in place of those of the same name."""
    kept = live.join(candidates.select("source_id").distinct(), "source_id", "left_anti")
    return kept.unionByName(candidates, allowMissingColumns=True)


def definition_errors(defs: DataFrame) -> DataFrame:
    """Why rows of a definition table (source_id, fingerprint, tokenizer, mapping) cannot be used."""
    fps, toks = ", ".join(f"'{f}'" for f in FINGERPRINTS), ", ".join(f"'{t}'" for t in TOKENIZERS)
    missing = " ".join(f"WHEN {c} IS NULL THEN 'missing required key \\'{k}\\''" for c, k in
                       (("source_id", "source_id"), ("fingerprint", "fingerprint"), ("tokenizer", "tokenize"),
                        ("mapping", "mapping")))
    return defs.withColumn("error", F.expr(
        f"CASE {missing} WHEN fingerprint NOT IN ({fps}) THEN concat('unknown fingerprint type: ', fingerprint)"
        f" WHEN tokenizer NOT IN ({toks}) THEN concat('unknown tokenize type: ', tokenizer) END")).filter("error IS NOT NULL")


def report(parsers: DataFrame, per_source: DataFrame) -> DataFrame:
    """Registry rows with what each parser did; parsers without traffic stay."""
    stats = per_source.select(F.col("source").alias("source_id"), "parsed", "dlq")
    return parsers.join(stats, "source_id", "left").withColumn("parsed", F.coalesce("parsed", F.lit(0))).withColumn(
        "dlq", F.coalesce("dlq", F.lit(0)))


def fingerprint_overlap(samples: DataFrame, registry, key: str = "cluster_id", text: str = "text") -> DataFrame:
    """(key, source_id, hits, total): how many samples each live fingerprint claims.

    One boolean per parser and one aggregation; samples are never paired with parsers.
    """
    from ..plans.pipeline import candidates

    hits = candidates(samples.withColumnRenamed(text, "text") if text != "text" else samples, registry)
    sums = [F.count_if(F.array_contains("candidates", s)).alias(f"h{i}") for i, s in enumerate(registry.source_ids())]
    agg = hits.groupBy(key).agg(F.count("*").alias("total"), *sums)
    pairs = ", ".join(f"'{s}', h{i}" for i, s in enumerate(registry.source_ids()))
    return agg.selectExpr(key, "total", f"stack({len(registry.parsers)}, {pairs}) AS (source_id, hits)").filter("hits > 0")


def mapping_conflicts(proposed: DataFrame, live: DataFrame) -> DataFrame:
    """Tokens a proposal maps to another path than a live parser does."""
    a = proposed.select("token", F.col("path").alias("proposed_path"), *[c for c in proposed.columns if c not in ("token", "path")])
    b = live.select("token", F.col("path").alias("live_path"), F.col("source_id").alias("live_source"))
    return a.join(b, "token").filter("proposed_path <> live_path")


__all__ = ["live_versions", "current", "previous", "bump_sql", "promoted_version", "overlay", "definition_errors",
           "report", "fingerprint_overlap", "mapping_conflicts", "latest"]
