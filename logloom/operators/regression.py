"""Regression gate: a parser set must still claim every corpus line as expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.interpreted import claims
from ..plans.lineage import cut
from ..plans.pipeline import parse_flat


def check(corpus: DataFrame, expectations: DataFrame, registry) -> DataFrame:
    """Corpus lines (file, line_no, text) against (file, source_id, channel, class_uid).

    Adds ``failure`` (NULL when the line behaves).  The expectations are a small
    table by design; Spark decides from its size whether to broadcast it.
    """
    exp = expectations.select("file", F.col("source_id").alias("_want"), "channel", F.col("class_uid").alias("_class"))
    rows = corpus.join(exp, "file").withColumn("event_id", F.lit("00000000-0000-4000-8000-000000000000")).withColumn(
        "sha256", F.expr("repeat('0', 64)")).withColumn(
        "raw_ref", F.lit("local://regression/00000000-0000-4000-8000-000000000000"))
    out = parse_flat(rows, registry)
    got = "metadata__source_id"
    return out.selectExpr(
        "file", "line_no", f"{got} AS source_id", "class_uid",
        f"CASE WHEN reason IS NOT NULL AND _want IS NOT NULL THEN concat('expected ', _want, ', got DLQ (', reason, ')')"
        f" WHEN reason IS NOT NULL THEN NULL"
        f" WHEN _want IS NULL THEN concat('expected DLQ (garbage), but parsed by ', {got})"
        f" WHEN {got} <> _want THEN concat('expected ', _want, ', but ', {got}, ' claimed it')"
        f" WHEN _class IS NOT NULL AND class_uid <> _class THEN concat('expected class ', _class, ', got ', class_uid) END AS failure")


def gate(checked: DataFrame) -> DataFrame:
    """One row: total, failed, passed."""
    return checked.agg(F.count("*").alias("total"), F.count("failure").alias("failed")).withColumn(
        "passed", F.col("failed") == 0)


_EVENT = {"event_id": "'00000000-0000-4000-8000-000000000000'", "sha256": "repeat('0', 64)",
          "raw_ref": "'local://regression/00000000-0000-4000-8000-000000000000'"}


def _failure(winner: str) -> str:
    """Why a line's claim is not the expected one, from a (source_id, class_uid) struct; NULL when it is."""
    return (f"CASE WHEN {winner} IS NULL AND _want IS NOT NULL THEN concat('expected ', _want, ', got DLQ') WHEN {winner} IS NULL THEN NULL"
            f" WHEN _want IS NULL THEN concat('expected DLQ (garbage), but parsed by ', {winner}.source_id)"
            f" WHEN {winner}.source_id <> _want THEN concat('expected ', _want, ', but ', {winner}.source_id, ' claimed it')"
            f" WHEN _class IS NOT NULL AND {winner}.class_uid <> _class THEN concat('expected class ', _class, ', got ', {winner}.class_uid) END")


def check_candidates(candidates: DataFrame, live: DataFrame, corpus: DataFrame, expectations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every candidate against the corpus, all in one plan.

    ``candidates`` (candidate, rules) each join the live set (source_id, position, rules) alone, in place of a live
    parser of the same source. Returns (candidate, total, failed, passed) and the failing lines that the candidate
    touches (candidate, file, line_no, failure).

    All definitions are judged on all lines at once. A candidate's verdict differs from the live set's only on lines
    that it or the parser it replaces claims; only those are looked at per candidate, the others count as they are.
    """
    exp = expectations.select("file", F.col("source_id").alias("_want"), "channel", F.col("class_uid").alias("_class"))
    lines = cut(corpus.drop("channel").join(exp, "file").withColumns({k: F.expr(v) for k, v in _EVENT.items()}))
    keys = ["file", "line_no"]
    pool = live.select(F.concat(F.lit("live:"), "source_id").alias("definition_id"), "rules").unionByName(
        candidates.select(F.concat(F.lit("new:"), "candidate").alias("definition_id"), "rules"))
    order = F.struct(~F.col("prefers"), -F.col("priority"), F.coalesce("position", F.lit(2**31 - 1)))
    places = live.select(F.concat(F.lit("live:"), "source_id").alias("definition_id"), "position")
    won = cut(claims(lines, pool, keys).filter("ok").join(places, "definition_id", "left").select(
        *keys, "definition_id", F.struct(order.alias("place"), "source_id", "class_uid").alias("claim")))
    of_live = won.filter("startswith(definition_id, 'live:')")
    by_line = of_live.groupBy(*keys).agg(F.collect_list("claim").alias("_live"))  # one row per live parser at most
    judged = cut(lines.select(*keys, "_want", "_class").join(by_line, keys, "left").withColumn(
        "_base", F.expr(_failure("array_min(_live)"))))
    whole = judged.agg(F.count("*").alias("n"), F.count("_base").alias("bad")).first()
    names = candidates.select("candidate", F.col("rules.source_id").alias("_source"))
    own = won.filter("startswith(definition_id, 'new:')").select(*keys, F.substring("definition_id", F.lit(5), F.lit(2**20)).alias(
        "candidate"), "claim").join(names, "candidate")
    replaced = of_live.join(names, F.col("claim.source_id") == F.col("_source")).select(
        *keys, "candidate", F.lit(None).cast(own.schema["claim"].dataType).alias("claim"), "_source")
    touched = own.select(*keys, "candidate", "claim", "_source").unionByName(replaced).groupBy(*keys, "candidate", "_source").agg(
        F.max("claim").alias("claim"))
    now = touched.join(judged, keys).withColumn("_now", F.expr(
        "array_min(concat(filter(coalesce(_live, array()), x -> x.source_id <> _source), array_compact(array(claim))))"))
    now = now.withColumn("failure", F.expr(_failure("_now")))
    change = now.groupBy("candidate").agg((F.count("failure") - F.count("_base")).alias("_change"))
    out = candidates.select("candidate").join(change, "candidate", "left").select(
        "candidate", F.lit(whole["n"]).cast("long").alias("total"), (F.lit(whole["bad"]) + F.coalesce("_change", F.lit(0))).alias("failed"))
    return out.withColumn("passed", F.col("failed") == 0), now.filter("failure IS NOT NULL").select("candidate", *keys, "failure")
