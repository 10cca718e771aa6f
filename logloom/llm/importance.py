"""Operator 11: target-distribution importance resampling over a head-tail vocabulary.

A text's features are all runs of 1 to ``n`` consecutive words; a feature's bucket is the CRC-32 of its bytes
modulo the number of buckets. Two bounded tables, the head, are broadcast: the CRC state of every frequent word
and the CRC of every frequent pair of them. As a CRC continues where another one ended, a longer run takes the
state of the run without its last word; a feature outside the head, the tail, takes its CRC directly. Head and
tail give the same numbers, so totals are exact and the head only saves work. Its bound: a word (a pair) is
frequent if it has at least a 2**-15 part of all words (pairs), so there are at most 2**15 of each, and words of
over ``LONGEST`` bytes are left to the tail.

With s of S source features and t of T target features in a bucket, its gain is the log ratio of the two smoothed
shares. A document's weight is the mean gain of its features; with a Gumbel number drawn from the hash of its id
added, the highest scores are a sample without replacement by the weights. Ranks come from one range sort: a
position inside its part plus the rows of the parts before, so that no task holds more than a part.

Defined cases: null and empty texts have no words, weight 0 and no rank; a null doc_id is hashed as the empty
text and comes first among equal scores; rows that repeat are weighed and ranked one by one; an empty table
gives an empty result, an empty target leaves the source's shares to decide. Other columns are not carried.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, saved, table, text_bytes

HEAD, LONGEST, FLUSH = 1 << 15, 64, 200_000
#: A-Z in lower case, every byte that no word has as a blank: words are [0-9a-z] and whatever isn't ASCII.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_PLAIN).split()


def _texts(batches):
    """(first row, words of each text) of runs of rows of about 4 MB."""
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        raw = data.tobytes()
        for i, j in chunks(bounds, 4 << 20):
            yield batch, i, [words_of(raw[a:b]) for a, b in itertools.pairwise(bounds[i:j + 1].tolist())]


class _States(dict):
    """CRC states of the frequent words; any other word's is computed."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Features:
    """Buckets of all runs of 1 to ``n`` words, with the two tables of the head."""

    def __init__(self, n: int, buckets: int, words: list[bytes] = (), pairs: list[tuple[bytes, bytes]] = ()):
        self.n, self.buckets = n, buckets
        self.states = _States((w, zlib.crc32(w)) for w in words)
        self.place = {w: i for i, w in enumerate(words)}
        keys = np.array([self.place[a] * len(self.place) + self.place[b] for a, b in pairs], np.int64)
        crcs = np.array([zlib.crc32(b" " + b, self.states[a]) for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_crcs = keys[order], crcs[order]

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, text of each) of the features of some texts."""
        flat = list(itertools.chain.from_iterable(texts))
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        state = np.fromiter(map(self.states.__getitem__, flat), np.int64, len(flat))
        crcs, owners = [state], [text]
        for k in range(2, self.n + 1):
            starts = np.flatnonzero(text[:-(k - 1)] == text[k - 1:]) if len(flat) >= k else np.zeros(0, np.int64)
            longer = np.zeros(len(flat), np.int64)
            rest = starts
            if k == 2 and len(self.pair_keys):
                place = np.fromiter(map(self.place.get, flat, itertools.repeat(-1)), np.int64, len(flat))
                a, b = place[starts], place[starts + 1]
                key = np.where((a < 0) | (b < 0), -1, a * len(self.place) + b)
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                met = self.pair_keys[at] == key
                longer[starts[met]] = self.pair_crcs[at[met]]
                rest = starts[~met]
            last = [flat[i + k - 1] for i in rest.tolist()]
            longer[rest] = [zlib.crc32(b" " + w, s) for w, s in zip(last, state[rest].tolist(), strict=True)]
            state = longer
            crcs.append(longer[starts])
            owners.append(text[starts])
        return np.concatenate(crcs) % self.buckets, np.concatenate(owners)


def _counted(df: DataFrame, items) -> DataFrame:
    """(item, n) of ``items`` (words of a text -> iterable) over all texts: counted in each task first, in a
    table that is handed on when it has ``FLUSH`` entries."""
    def run(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_pydict({"item": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        for _, _, texts in _texts(batches):
            for words in texts:
                seen.update(items(words))
                if len(seen) > FLUSH:
                    yield rows()
        yield rows()

    return df.select("text").mapInArrow(run, "item binary, n long").groupBy("item").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame) -> list[bytes]:
    """Items with at least a HEAD-th part of all: HEAD of them at most."""
    counts = saved(counts)
    whole = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = counts.filter((F.col("n") * HEAD >= F.lit(whole)) & (F.octet_length("item") <= 2 * LONGEST + 1)).select("item").collect()
    return sorted(bytes(r["item"]) for r in rows)


def features(docs: DataFrame, n: int = 2, buckets: int = 10_000) -> Features:
    """The head of ``docs`` (text), from exact counts over all texts."""
    words = [w for w in _frequent(_counted(docs, lambda words: words)) if len(w) <= LONGEST]
    if n == 1:
        return Features(n, buckets, words)
    known = frozenset(words)
    pairs = _frequent(_counted(docs, lambda words: [a + b" " + b for a, b in itertools.pairwise(words) if a in known and b in known]))
    return Features(n, buckets, words, [tuple(p.split(b" ")) for p in pairs])


def bucket_totals(docs: DataFrame, head: Features) -> np.ndarray:
    """Features in each bucket, over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        found = np.zeros(shared.value.buckets, np.int64)
        for _, _, texts in _texts(batches):
            found += np.bincount(shared.value.of(texts)[0], minlength=len(found))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    out = np.zeros(head.buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * log of (smoothed share in the target / smoothed share in the source)) of each bucket."""
    n = len(source)
    s_all, t_all = float(int(source.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(scale * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(
        source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, head: Features, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))

    def run(batches):
        head, gain = shared.value
        for batch, i, texts in _texts(batches):
            m = len(texts)
            buckets, owner = head.of(texts)
            order = np.argsort(owner, kind="stable")
            n = np.bincount(owner, minlength=m)
            before = np.concatenate([[0], np.cumsum(gain[buckets[order]])])
            ends = np.cumsum(n)
            total = before[ends] - before[ends - n]
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, m), pa.array([len(t) for t in texts], pa.int64()), pa.array(
                n, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = 2024, scale: int = 1000) -> DataFrame:
    """Adds ``score``: the weight and a Gumbel number from the hash of (seed, doc_id), both floored to 1/scale."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-float(scale)) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + gumbel)


def drawn(rows: DataFrame, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Adds ``rank``, 1 for the highest score, to the best ``percent`` per cent (rounded down) of the rows with at
    least ``least_words`` words; equal scores follow doc_id. All other rows have none."""
    rows = saved(rows)
    able = F.col("n_words") >= least_words
    most = rows.filter(able).count() * percent // 100
    at = F.monotonically_increasing_id()
    # copies of one row are dealt by their place in the saved table, so that many of them can't fill one part
    placed = rows.filter(able).withColumn("_at", at)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_at")]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    placed = saved(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.expr("_at & 8589934591L")))
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_before") + F.col("_nth") + 1
    ranked = placed.join(before.drop("_n"), "_part").withColumn("rank", F.when(place <= most, place))
    names = [*rows.columns, "rank"]
    return ranked.select(*names).unionByName(rows.filter(~F.coalesce(able, F.lit(False))).withColumn(
        "rank", F.lit(None).cast("long")).select(*names))


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, seed: int = 2024,
             least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), with the
    distribution of ``target`` (text) aimed at."""
    head = features(docs, n, buckets)
    gain = gains(bucket_totals(docs, head), bucket_totals(target, head))
    return drawn(scored(weighed(docs, head, gain), seed), least_words, percent)


def op11_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1).select(
        "doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: the table follows from the polynomial, the bytes of a text are folded one after the other.
CRC_SQL = """crc_step AS (
  WITH RECURSIVE s AS (
    SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) r(b)
    UNION ALL
    SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM s WHERE k < 8)
  SELECT b, c FROM s WHERE k = 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_step)"""


def crc_sql(text: str, t: str = "t") -> str:
    """CRC-32 of a text's UTF-8 bytes; ``t`` is the table of ``crc_table``."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b:"
            f" xor(c >> 8, {t}[(xor(c, b) & 255) + 1])), 4294967295)")


ORACLE = f"""
WITH {CRC_SQL},
words AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
cut AS (SELECT side, id, r, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM words),
feature AS (SELECT side, r, unnest(w) AS word FROM cut),
bucket AS (SELECT word, ({crc_sql("word")} % 10000) AS bucket FROM (SELECT DISTINCT word FROM feature), crc_table),
dealt AS (SELECT f.side, f.r, b.bucket FROM feature f JOIN bucket b USING (word)),
total AS (SELECT (SELECT count(*) FROM dealt WHERE side = 'd') AS s_all, (SELECT count(*) FROM dealt WHERE side = 'b') AS t_all),
per AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM dealt GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT
  AS g FROM per, total),
weight AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dealt JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT c.id AS doc_id, len(c.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(c.id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
      / 4294967296)))::BIGINT AS score
  FROM cut c LEFT JOIN weight w ON w.r = c.r WHERE c.side = 'd'),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
  count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM placed
"""

QUERIES = {"op11_importance": op11_importance}
ORACLES: dict[str, str] = {"op11_importance": ORACLE}
