"""Operator 12: spelling variants through pivotal grams.

Two words are near if one inserted, deleted or replaced code point makes one the other. A word's bigrams are
ordered rare first; its prefix is the first three of them (and whatever equals the third). Dynamic programming
chooses the two disjoint bigrams of least frequency from the prefix, the pivots: an edit can't touch both.
Let a be the left pivot and b the right one. An edit right of a leaves the word up to the end of a as it is,
an edit up to the end of a leaves the word from the start of b on as it is; so one pivot survives at its place,
counted from the left or from the right, with everything beyond it. Of two near words take the one whose prefix
ends earlier in the order: its surviving pivot is in the other word's prefix. So pivots are joined with prefix
bigrams on that untouched part of the word (the position limit: same bigram, same distance from that end, lengths
one apart at most), and each pair is verified once by its edit distance.

The order of bigrams is by their count in a table of 2**16 hash slots, then by the bigram: any total order is
right, and what is sent to the tasks is bounded whatever the alphabet.

A word's form is its near word of the largest count, if that is ``ratio`` times its own or more; counts at least
double along forms, so following them to the root by doubling steps ends after a few.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text in ``noised``; equal
counts go to the smaller word in code-point order; words of under ``LEAST`` code points have no two disjoint
bigrams in three and are refused; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .importance import CRC_SQL, crc_sql

SLOTS, Q, EDITS, LEAST = 1 << 16, 2, 1, 4
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def grams(word: str) -> list[str]:
    return [word[i:i + Q] for i in range(len(word) - Q + 1)]


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) % SLOTS


def prefix_of(word: str, counts: np.ndarray) -> list[tuple[tuple[int, str], int]]:
    """((count, gram), position) of the word's prefix, rare first: Q * EDITS + 1 grams and those equal to the last."""
    order = sorted(((int(counts[_slot(g)]), g), i) for i, g in enumerate(grams(word)))
    n = Q * EDITS + 1
    while n < len(order) and order[n][0] == order[n - 1][0]:
        n += 1
    return order[:n]


def pivots_of(prefix: list[tuple[tuple[int, str], int]]) -> list[int]:
    """Positions of the EDITS + 1 disjoint grams of the least total count: best[k] after a gram is the cheapest
    choice of k disjoint ones up to it."""
    by_place = sorted((place, order[0]) for order, place in prefix[:Q * EDITS + 1])
    best: list[list] = []  # for each gram, for each k: (cost, positions)
    for i, (place, cost) in enumerate(by_place):
        row = [(0, ())]
        fits = next((best[j] for j in range(i - 1, -1, -1) if by_place[j][0] + Q <= place), [(0, ())])
        for k in range(1, EDITS + 2):
            took = (fits[k - 1][0] + cost, (*fits[k - 1][1], place)) if k - 1 < len(fits) and fits[k - 1] else None
            left = best[i - 1][k] if i and k < len(best[i - 1]) else None
            row.append(min(x for x in (took, left) if x) if took or left else None)
        best.append(row)
    return list(best[-1][EDITS + 1][1])


def gram_counts(words: DataFrame) -> np.ndarray:
    """Counts of bigrams in their SLOTS slots, each word counted once."""
    def run(batches):
        found = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for w in batch.column("word").to_pylist():
                for g in grams(w):
                    found[_slot(g)] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in words.select("word").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _parts(words: DataFrame, counts: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(pivots, prefixes): word, size, the part of the word that an edit beyond it leaves alone, with its side, and
    ``last``, the order of the prefix's last gram."""
    schema = "pivot boolean, side int, part string, size int, word string, last_n long, last_gram string"

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for w in batch.column("word").to_pylist():
                prefix = prefix_of(w, counts)
                last_n, last_gram = prefix[-1][0]
                a, *_, b = pivots_of(prefix)
                rows = [(True, 0, w[:a + Q]), (True, 1, w[b:])]
                rows += [(False, side, w[:i + Q] if not side else w[i:]) for _, i in prefix for side in (0, 1)]
                for pivot, side, part in rows:
                    for column, value in zip(out, (pivot, side, part, len(w), w, last_n, last_gram), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (
                pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True)],
                ["pivot", "side", "part", "size", "word", "last_n", "last_gram"])

    rows = saved(words.select("word").mapInArrow(run, schema))
    return rows.filter("pivot").drop("pivot"), rows.filter("not pivot").drop("pivot")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs of distinct words (``word``, each once) one edit apart."""
    short = words.filter(F.char_length("word") < LEAST).limit(1).count()
    if short:
        raise ValueError(f"words need {LEAST} code points or more")
    pivots, prefixes = _parts(words, gram_counts(words))
    # the lengths are in the key: one row of a pivot for each of the three that can match
    r = prefixes.alias("r")
    p = pivots.withColumn("other", F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)]))).alias("p")
    met = p.join(r, (F.col("p.side") == F.col("r.side")) & (F.col("p.part") == F.col("r.part")) & (F.col("p.other") == F.col(
        "r.size")) & (F.struct("p.last_n", "p.last_gram") <= F.struct("r.last_n", "r.last_gram")) & (F.col("p.word") != F.col(
            "r.word")) & (F.levenshtein("p.word", "r.word", 1) == 1))
    return met.select(F.least("p.word", "r.word").alias("a"), F.greatest("p.word", "r.word").alias("b")).distinct()


def forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of ``words`` (word, n; each word once)."""
    words = saved(words.select("word", "n"))
    pairs = saved(near_pairs(words))
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = links.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(
        -F.col("near_n"), "near")).alias("best"))
    enough = F.col("best.near_n") >= ratio * F.col("n")
    told = saved(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, F.col("best.near_n")).alias("form_n")))
    jumps = told.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jumps = saved(jumps.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col(
            "beyond").isNotNull().alias("moved")))
        if not jumps.filter("moved").limit(1).count():
            break
        jumps = jumps.drop("moved")
    return told.join(jumps.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def runs(docs: DataFrame, pattern: str = LETTERS) -> DataFrame:
    """(doc_id, run): maximal runs of letters of every text, A-Z in lower case."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("run"))


def noised(run: Column, doc_id: Column, one_in: int = 97) -> Column:
    """The run without its code point h % length where h, the CRC-32 of `doc_id:run`, is divisible by ``one_in``."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "utf-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_size: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``least_size`` code points that occur ``least_n`` times or more."""
    return words.filter(F.char_length("word") >= least_size).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def op12_variants(spark, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents")).select(noised(F.col("run"), F.col("doc_id")).alias("word"))
    return forms(vocabulary(found)).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words by brute means: with one code point left out at some place both words are equal, or one is the other.
ORACLE = f"""
WITH RECURSIVE {CRC_SQL},
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM run GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM each, crc_table),
word AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END
  AS word, n FROM hashed),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM word WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word AS word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.rest FROM cut a JOIN vocab v ON v.word = a.rest
  UNION SELECT a.rest, a.word FROM cut a JOIN vocab v ON v.word = a.rest),
best AS (SELECT word, count(*) AS n_near, (array_agg(near ORDER BY n DESC, near))[1] AS near, max(n) AS near_n
  FROM (SELECT e.word, e.near, v.n FROM near e JOIN vocab v ON v.word = e.near) GROUP BY word),
told AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
  CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM vocab v LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS here, 0 AS k FROM told UNION ALL SELECT w.word, t.form, k + 1 FROM walk w JOIN told t ON t.word = w.here WHERE t.form IS NOT NULL),
root AS (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM told JOIN root USING (word)
"""

QUERIES = {"op12_variants": op12_variants}
ORACLES: dict[str, str] = {"op12_variants": ORACLE}
