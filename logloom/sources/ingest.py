"""Sources: log files, batch bodies, framed byte streams, datagrams, the event lake."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqltext import strip
from ..schema import event_schema


def read_lines(spark: SparkSession, path: str, channel: str = "file:log") -> DataFrame:
    """Log files -> one event per non-blank line (``raw`` BINARY, ``channel``, ``file``)."""
    return _lines(spark.read.text(path), channel)


def stream_lines(spark: SparkSession, path: str, channel: str = "file:log", max_files: int | None = None) -> DataFrame:
    """Landing directory as a stream; the checkpoint remembers which files were read."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _lines(reader.load(path), channel)


def _lines(df: DataFrame, channel: str) -> DataFrame:
    df = df.selectExpr(f"{strip('value')} AS line", "_metadata.file_path AS file",
                       "_metadata.file_modification_time AS ingest_time")
    return df.filter("line <> ''").select(F.col("line").cast("binary").alias("raw"), F.lit(channel).alias("channel"),
                                          F.lit(None).cast("string").alias("source_hint"), "ingest_time", "file")


def split_lines(df: DataFrame, col: str = "value", channel: str = "file:log") -> DataFrame:
    """The same rule for a table whose text column holds whole file bodies."""
    lines = df.select("*", F.posexplode(F.split(F.col(col), "\r\n|\n|\r")).alias("line_no", "_line"))
    return lines.selectExpr(*df.columns, "line_no", f"{strip('_line')} AS line", f"'{channel}' AS channel").filter("line <> ''")


BATCH_BODY = "events ARRAY<STRUCT<raw: STRING, channel: STRING, source_hint: STRING>>"


def explode_batches(df: DataFrame, body: str = "body") -> DataFrame:
    """Batch bodies {"events": [...]} -> one row per event; a missing ``raw`` sets ``error``.

    Strings are unquoted; objects and lists become JSON text with their keys in the order sent, but
    ``from_json`` rewrites fractions (2.50 as 2.5) and drops blanks.  ``read_batch_json`` doesn't.
    """
    parsed = df.select("*", F.from_json(F.col(body), BATCH_BODY).alias("_b"))
    return _batch_events(parsed, "_b.events", df.columns)


def _batch_events(parsed: DataFrame, events: str, keep: list[str]) -> DataFrame:
    rows = parsed.select(*keep, F.posexplode(events).alias("event_no", "_e")).filter("_e IS NOT NULL")
    return rows.selectExpr(
        *keep, "event_no", "coalesce(_e.channel, 'http') AS channel", "_e.source_hint AS source_hint",
        "CAST(_e.raw AS BINARY) AS raw",
        "CASE WHEN _e.raw IS NULL THEN 'missing \\'raw\\' field' END AS error")


def read_batch_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of files that hold one body each; objects, lists and numbers keep their exact text."""
    rows = _batch_events(spark.read.schema(BATCH_BODY).json(path, multiLine=True), "events", [])
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL")


_OCTETS = re.compile(rb"(\d{1,6}) ")
_TRIM = b"\r\n\x00"


def frames(blob: bytes) -> Iterator[bytes]:
    """Messages of one captured TCP stream: octet-counted or newline-framed, mixed."""
    at, end = 0, len(blob)
    while at < end:
        m = _OCTETS.match(blob, at)
        if m:
            stop = m.end() + int(m.group(1))
            if stop > end:
                break
            msg, at = blob[m.end():stop], stop
        else:
            nl = blob.find(b"\n", at)
            if nl < 0:
                break
            msg, at = blob[at:nl], nl + 1
        msg = msg.strip(_TRIM)
        if msg:
            yield msg
    rest = blob[at:].strip()
    if rest:
        yield rest


def unframed(streams: Iterator[tuple], most: int = 10_000) -> Iterator[list[tuple]]:
    """Lists of ``most`` messages (keys, frame_no, raw) over any number of streams (keys, blob), short or long."""
    out = []
    for *head, blob in streams:
        for i, msg in enumerate(frames(bytes(blob))):
            out.append((*head, i, msg))
            if len(out) == most:
                yield out
                out = []
    if out:
        yield out


def deframe_syslog(df: DataFrame, blob_col: str = "content", key_cols=("path",)) -> DataFrame:
    """Captured byte streams -> (keys, frame_no, raw).

    Finding a frame needs the end of the one before, so one stream is scanned in
    order; streams are spread over the tasks and results leave batch by batch.
    """
    keys = list(key_cols)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", frame_no BIGINT, raw BINARY"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streams = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
        for out in unframed(streams):
            yield pd.DataFrame(out, columns=[*keys, "frame_no", "raw"])

    return df.select(*keys, blob_col).mapInPandas(run, schema)


def read_tcp_captures(spark: SparkSession, path: str) -> DataFrame:
    return deframe_syslog(spark.read.format("binaryFile").load(path).select("path", "content"))


def read_datagrams(df: DataFrame, col: str = "packet", out: str = "raw") -> DataFrame:
    """One packet, one event: trailing CR, LF and NUL bytes are cut off."""
    # ISO-8859-1 maps every byte to one character and back, so no byte changes
    exact = f"encode(rtrim('\\r\\n\\u0000', decode(`{col}`, 'ISO-8859-1')), 'ISO-8859-1')"
    return df.withColumn(out, F.expr(exact))


def read_normalized(spark: SparkSession, path: str, source: str | None = None, day: str | None = None,
                    fmt: str = "parquet") -> DataFrame:
    """Events back from the lake; source and day prune partitions."""
    reader = spark.read.schema(T.StructType([*event_schema().fields, T.StructField("source_id", T.StringType()), T.StructField("day", T.StringType())]))
    df = reader.format(fmt).load(path)
    if source:
        df = df.filter(F.col("source_id") == source)
    if day:
        df = df.filter(F.col("day") == day)
    return df


def spread(df: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """The same rows dealt by ``key`` over tasks of about ``rows`` each.

    A scan's tasks follow the bytes of its files. A narrow, well packed table then gives few tasks, whatever each row
    costs later; here their number follows the rows (counted from the files' footers), at the price of one shuffle.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, key)


def mint_ids(df: DataFrame, row_key: str, raw: str = "raw", channel: str = "channel",
             source: str | None = None, number_equal: bool = False) -> DataFrame:
    """Adds event_id, sha256, size_bytes and raw_ref.

    The id is a hash of (channel, row key, content hash) in UUID shape: a retried
    task or a second action yields the same id, so archive and events stay linked.
    Where the row key doesn't tell equal lines apart (a file name), ``number_equal`` numbers
    them: equal rows are interchangeable, so the ids of a retry are the same set.  It shuffles
    on (channel, row key, hash); the equal lines of one key go through one task as a stream.
    """
    keep = [f"`{c}`" for c in df.columns if c not in ("event_id", "sha256", "size_bytes", "raw_ref")]
    df = df.selectExpr(*keep, f"sha2(`{raw}`, 256) AS sha256", f"CAST(octet_length(`{raw}`) AS BIGINT) AS size_bytes")
    if number_equal:
        df = df.selectExpr("*", f"row_number() OVER (PARTITION BY `{channel}`, {row_key}, sha256 ORDER BY sha256) AS _nth")
        row_key = f"concat_ws('#', CAST({row_key} AS STRING), nullif(_nth, 1))"
    df = df.selectExpr("*", f"sha2(concat_ws('|', `{channel}`, CAST({row_key} AS STRING), sha256), 256) AS _h")
    uid = ("concat_ws('-', substr(_h, 1, 8), substr(_h, 9, 4), substr(_h, 13, 4), substr(_h, 17, 4),"
           " substr(_h, 21, 12))")
    df = df.selectExpr(f"* EXCEPT (_h{', _nth' if number_equal else ''})", f"{uid} AS event_id")
    hint = "source_hint" if "source_hint" in df.columns else "CAST(NULL AS STRING)"
    name = source or f"coalesce({hint}, substring_index(`{channel}`, ':', -1))"
    return df.selectExpr("*", f"concat('local://', {name}, '/', event_id) AS raw_ref")
