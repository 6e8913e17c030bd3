"""The corpus pipeline: five stages over the documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents and all the rows that its decision leaves.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, copies, leaks, privacy, toxicity
from eventloom.llm.common import free_name, row_key, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows_left(docs: DataFrame, rows: DataFrame, how: str, once: bool = False) -> DataFrame:
    """Semi or anti join of the documents by the key of id and text, under a name that no column of theirs has. With
    ``once``, rows equal in id and text are left once: they meet by the key already, so the texts do not move again."""
    key = free_name(docs, "__row")
    left = docs.withColumn(key, row_key("doc_id", "text")).join(rows.select(F.col("row").alias(key)).distinct(), key, how)
    return (left.dropDuplicates([key]) if once else left).select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below 0.7. The model learns from the labels outside the held-out fold and from the
    texts of this stage's own input."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.fold()))
    out = free_name(docs, "__score")
    return toxicity.score(docs, model, out=out).where(F.col(out) < 0.7).select(*docs.columns)


def one_of_each_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity of 0.8 or more. The least doc_id
    stays; documents without words are no copies of each other, rows equal in id and text are."""
    kept = copies.link_copies(docs, k=5, num=80, den=100, without_common=True).where("keep")
    return _rows_left(docs, kept, "left_semi", once=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 80 % of the five-word shingles of every benchmark item; of an item of
    under five words, that do not hold its words together."""
    return _rows_left(docs, leaks.find_leaks(docs, table(spark, sf_dir, "benchmark"), short=True), "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    masked = privacy.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and text, decoded from the ids again."""
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", one_of_each_copy),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("bpe", tokens),
]

#: No SQL: the toxicity model is fitted and the tokens are merged by rank; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves is written to the shared checkpoint folder and read from there."""
    docs = table(spark, sf_dir, "documents")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stages")
    root = f"{folder.rstrip('/')}/stages-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
