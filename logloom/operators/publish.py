"""Publishing several tables at once, versions that only one can take, and the two jobs that need them: replaying
quarantined rows and promoting a definition.

Tables are written below a folder of the publish id and count only when its manifest exists; the manifest appears by
one rename. An attempt that dies in between leaves files that no reader looks at and that the next attempt of
the same id overwrites; one that comes after the manifest changes nothing. Registry versions are files that are
created only if absent, so two promotions never take one number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.pipeline import parse_flat, to_events
from ..plans.registry import Registry
from . import dlq, heal
from .archive import replay_source
from .registry_log import live_versions, promoted_version

LOG = "source_id STRING, seq BIGINT, version STRING, action STRING, definition STRING"


class Store:
    """A folder on any store that Hadoop reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def create(self, path: str, text: str) -> bool:
        """Writes a file that isn't there yet; False when it is."""
        try:
            out = self._fs.create(self._path(path), False)
        except Exception as e:
            if self.exists(path):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    # ------------------------------------------------------------ tables
    def committed(self) -> list[str]:
        return [n for n in self.names("_manifest") if not n.startswith((".", "_"))]

    def publish(self, publish_id: str, tables: Mapping[str, Callable[[], DataFrame]]) -> bool:
        """Writes all tables and makes them visible together; False when the id has been published before."""
        if not publish_id or publish_id.startswith((".", "_")) or "/" in publish_id:
            raise ValueError("a publish id is a plain name")
        if publish_id in self.committed():
            return False
        for name, table in tables.items():
            table().write.mode("overwrite").parquet(f"{self.root}/{name}/publish={publish_id}")
        draft = f"_manifest/.{publish_id}.{uuid.uuid4().hex}"
        self.create(draft, json.dumps({"tables": sorted(tables)}))
        return bool(self._fs.rename(self._path(draft), self._path(f"_manifest/{publish_id}")))

    def read(self, name: str, schema) -> DataFrame:
        """All committed rows of a table with their ``publish`` id."""
        found = [f"{self.root}/{name}/publish={i}" for i in self.committed() if self.exists(f"{name}/publish={i}")]
        if not found:
            return self.spark.createDataFrame([], schema).withColumn("publish", F.lit(None).cast("string"))
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*found).withColumn(
            "publish", F.regexp_extract("_metadata.file_path", "publish=([^/]*)/", 1))


# ---------------------------------------------------------------- replay
def replay(store: Store, replay_id: str, pending: DataFrame, archive: DataFrame, registry: Registry, at) -> DataFrame:
    """Replays quarantined rows: events of those that parse now and their status ``replayed``, published together.

    Returns one row per attempted cluster: attempted, parsed, still_failing, original_missing. Rows whose original is
    neither in the archive nor whole in the snippet aren't parsed from a part of it; they are counted as missing.
    """
    rows = replay_source(pending, archive).withColumnsRenamed({"reason": "was", "parser_id": "was_parser"})
    rows = rows.drop("was", "was_parser", "text").withColumnRenamed("raw_sha256", "sha256").withColumn(
        "size_bytes", F.expr("CAST(octet_length(raw) AS BIGINT)"))
    whole = rows.filter("raw IS NOT NULL")
    flat = cut(parse_flat(whole, registry))  # read by both tables: parsed once
    good = flat.filter("reason IS NULL")
    store.publish(replay_id, {"events": lambda: to_events(good), "status": lambda: dlq.set_status(good, "replayed", at)})
    outcome = flat.groupBy("cluster_id").agg(F.count_if(F.col("reason").isNull()).alias("parsed"), F.count("reason").alias("still_failing"))
    every = rows.groupBy("cluster_id").agg(F.count("*").alias("attempted"), F.count_if(F.col("raw").isNull()).alias("original_missing"))
    return every.join(outcome, "cluster_id", "left").select(
        "cluster_id", "attempted", F.coalesce("parsed", F.lit(0)).alias("parsed"), F.coalesce("still_failing", F.lit(0)).alias("still_failing"), "original_missing")


# ---------------------------------------------------------------- registry
def registry_log(store: Store) -> DataFrame:
    """Every version entry ever appended (LOG)."""
    if not store.names("_registry"):
        return store.spark.createDataFrame([], LOG)
    return store.spark.read.schema(LOG).json(f"{store.root}/_registry", recursiveFileLookup=True)


def append(store: Store, source_id: str, version: str | None, action: str, definition: str | None) -> int:
    """Appends an entry of one source under the next free number, and returns it."""
    if not source_id or "/" in source_id or source_id.startswith((".", "_")):
        raise ValueError("a source id is a plain name")
    while True:
        seq = len(store.names(f"_registry/{source_id}")) + 1
        entry = {"source_id": source_id, "seq": seq, "version": version, "action": action, "definition": definition}
        if store.create(f"_registry/{source_id}/{seq:09d}.json", json.dumps(entry)):
            return seq


def current_registry(store: Store, base: Registry) -> Registry:
    """``base`` with the promoted definitions in place of those of the same source."""
    log = registry_log(store)
    now = live_versions(log.drop("definition")).filter("rank = 1").join(log.select("source_id", "seq", "definition"), ["source_id", "seq"])
    docs = [json.loads(r["definition"]) for r in now.orderBy("source_id").collect()]  # a parser set is a small table
    return base.overlay(*docs) if docs else base


def promote(store: Store, base: Registry, scored: DataFrame, definition: str, min_match_rate: float = heal.MIN_MATCH_RATE) -> dict:
    """Promotes one scored candidate (its row of ``heal.score`` with its proposal's ``status``) if the gate lets it.

    Its version is the live one's successor unless it names a higher one. Returns source_id, version and seq, or
    what ``refused`` it.
    """
    row = heal.promotable(scored, min_match_rate).first()
    if row is None:
        return {"refused": "no such candidate"}
    if row["refused"]:
        return {"refused": row["refused"]}
    doc = json.loads(definition)
    live = current_registry(store, base).get(doc["source_id"])
    versions = store.spark.createDataFrame([(doc.get("version"), str(live["version"]) if live else None)], "proposed STRING, live STRING")
    version = versions.selectExpr(f"{promoted_version('proposed', 'live')} AS v").first()["v"]
    seq = append(store, doc["source_id"], version, "promote", json.dumps({**doc, "version": version}))
    return {"source_id": doc["source_id"], "version": version, "seq": seq}


def rollback(store: Store, source_id: str) -> int:
    """Withdraws the newest promoted version of a source that still stands."""
    return append(store, source_id, None, "rollback", None)
