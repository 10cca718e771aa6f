"""The training-data pipeline: stages over the documents table, each written as Parquet and read by the next.

1. language ID: documents without a language (no letters, or a probability below ``LEAST_SCORE``) go;
2. n-gram Jaccard join: of documents that are linked by near-equal word shingles the least doc_id stays;
3. secret scans: secrets in the texts are replaced, n_chars follows; every document stays;
4. mixing: documents of scarce sources repeat, none goes;
5. BPE: ids of every text, with their number.

All but the last return the columns of documents, whatever other columns come along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, langid, mixing, ngram_join, secrets
from logloom.llm.common import saved, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3


def prepare_session(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of about 4 MB, since 10,000 rows may be any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told, and calls it their language."""
    prepare_session(spark)
    docs = docs.select(*COLUMNS)
    told = langid.identify(docs, langid.fit(docs.select("doc_id", "text", "lang"))).filter(
        (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group linked by five-word shingles at a similarity of 0.8 or
    more; documents without words are all kept, a row without an id too unless it is linked to another."""
    prepare_session(spark)
    docs = docs.select(*COLUMNS)
    told = ngram_join.Join(docs, k=5, percent=80).run()
    stay = saved(told.filter((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    nulls = F.col("doc_id").isNull() & F.lit(not stay.filter("doc_id is null").isEmpty())
    # rows that repeat a doc_id: one stays, as they are one group. One key for both steps, so texts are shuffled once
    first = docs.filter(worded & F.col("doc_id").isNotNull()).join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(*COLUMNS).unionByName(docs.filter(~worded | nulls).select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the sources come near their target weights."""
    return mixing.mixture(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each text."""
    prepare_session(spark)
    return bpe.encode(docs.select(*COLUMNS)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language_id", language_id), ("ngram_jaccard_join", near_duplicates), ("secret_scans", secret_scan),
          ("source_mixing", source_mixing), ("bpe_encoding", encoding)]

#: Language ID is a trained model: SQL can't express it. tests/llm checks every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage reads the table that the one before it wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
