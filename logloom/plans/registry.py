"""Parser definitions: load, check, order.

A definition is a declarative document (YAML or a dict).  The registry keeps the
valid ones in routing order and reports the others without stopping.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

CONFIG_DIR = Path(__file__).resolve().parent.parent / "configs"
REQUIRED = ("source_id", "fingerprint", "tokenize", "mapping")
FINGERPRINTS = ("contains", "startswith", "regex", "json_key", "all", "any")
TOKENIZERS = ("regex", "json", "kv", "csv", "cef", "leef", "xml")


def check_definition(doc) -> str | None:
    """Why a definition cannot be used, or None."""
    if not isinstance(doc, dict):
        return "definition must be a mapping"
    for key in REQUIRED:
        if key not in doc:
            return f"missing required key '{key}'"
    try:
        _check_fingerprint(doc["fingerprint"])
        spec = doc["tokenize"]
        if spec.get("type") not in TOKENIZERS:
            return f"unknown tokenize type: {spec.get('type')}"
        if spec["type"] == "regex":
            entries = spec.get("patterns") or [spec["pattern"]]
            for e in entries:
                re.compile(e if isinstance(e, str) else e["pattern"])
        if spec["type"] == "kv" and spec.get("pair_regex"):
            re.compile(spec["pair_regex"])
        for ex in (doc.get("mapping") or {}).get("extract") or []:
            re.compile(ex["pattern"])
    except KeyError as e:
        return f"missing required key {e}"
    except (ValueError, re.error, TypeError, AttributeError) as e:
        return str(e)
    return None


def _check_fingerprint(fp: dict) -> None:
    if fp["type"] not in FINGERPRINTS:
        raise ValueError(f"unknown fingerprint type: {fp['type']}")
    if fp["type"] in ("all", "any"):
        for rule in fp["rules"]:
            _check_fingerprint(rule)
    elif fp["type"] == "regex":
        re.compile(fp["pattern"])
    elif fp["type"] == "json_key":
        fp["key"]
    else:
        fp["pattern"]


def complete(doc: dict) -> dict:
    """Definition with its defaults filled in (the input is left alone)."""
    sid = doc["source_id"]
    channels = doc.get("channels") or ([doc["channel"]] if doc.get("channel") else [])
    return {
        "priority": 50, "version": "v1", "ocsf": {"class_uid": 0}, "log_name": sid,
        "product": {"name": sid, "vendor_name": sid}, **doc, "channels": list(channels),
        "mapping": doc.get("mapping") or {},
    }


@dataclass
class Registry:
    parsers: list[dict]
    errors: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def of(cls, docs: Iterable) -> Registry:
        good, bad = [], []
        for i, doc in enumerate(docs):
            problem = check_definition(doc)
            if problem:
                name = doc.get("source_id") if isinstance(doc, dict) else None
                bad.append((str(name or f"definition {i}"), problem))
            else:
                good.append(complete(doc))
        good.sort(key=lambda d: -int(d["priority"]))
        return cls(good, bad)

    @classmethod
    def load(cls, directory: str | Path = CONFIG_DIR) -> Registry:
        docs, bad = [], []
        for path in sorted(Path(directory).glob("*.yaml")):
            try:
                docs.append(yaml.safe_load(path.read_text(encoding="utf-8")))
            except yaml.YAMLError as e:
                bad.append((path.name, f"YAML syntax error: {e}"))
        reg = cls.of(docs)
        reg.errors = bad + reg.errors
        return reg

    def only(self, *source_ids: str) -> Registry:
        return Registry([p for p in self.parsers if p["source_id"] in source_ids])

    def overlay(self, *docs: dict) -> Registry:
        """Live set with candidates replacing the parsers of the same name."""
        ids = {d.get("source_id") for d in docs if isinstance(d, dict)}
        return Registry.of([p for p in self.parsers if p["source_id"] not in ids] + list(docs))

    def get(self, source_id: str) -> dict | None:
        return next((p for p in self.parsers if p["source_id"] == source_id), None)

    def source_ids(self) -> list[str]:
        return [p["source_id"] for p in self.parsers]

    def field_rows(self) -> list[tuple[str, str, str]]:
        """(source_id, token, destination path) of every field mapping."""
        rows = []
        for p in self.parsers:
            for token, dest in (p["mapping"].get("fields") or {}).items():
                for d in dest if isinstance(dest, list) else [dest]:
                    rows.append((p["source_id"], str(token), d))
        return rows

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p["source_id"], str(p["version"]), int(p["priority"]), p["channels"], p["fingerprint"]["type"],
                 p["tokenize"]["type"], int((p["ocsf"] or {}).get("class_uid") or 0),
                 len(p["mapping"].get("fields") or {}), yaml.safe_dump(p, sort_keys=False)) for p in self.parsers]
        return spark.createDataFrame(
            rows, "source_id STRING, version STRING, priority INT, channels ARRAY<STRING>, fingerprint STRING,"
                  " tokenizer STRING, class_uid INT, mapped_fields INT, yaml STRING")

    def errors_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.errors, "definition STRING, error STRING")

    def fields_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.field_rows(), "source_id STRING, token STRING, path STRING")
