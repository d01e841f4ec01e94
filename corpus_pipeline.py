"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, secret removal, packing.

Each stage works on all documents that its predecessor kept and returns the
columns of ``documents``; the last returns the packed pieces. ``n_chars``
follows the text where a stage changes it.

Null and empty texts fail the quality rules, so later stages see texts with
words; they would keep such rows all the same. Texts of any length are read
whole. Ties and repeated rows: of documents with one text, or one id and text,
the near-duplicate stage keeps one row. An empty table gives empty tables of the
same columns. Columns beyond those of ``documents`` are kept to the stage before
packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavemill.llm import decontam, packing, quality, secrets, simhash
from wavemill.llm.common import delete, materialize, work_dir
from wavemill.llm.registry import tokenizer_path


def _recount(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with n_chars of the new text, if the table has that column."""
    if "n_chars" not in after.columns:
        return after
    return after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: groups link texts at a five-word similarity of 0.8 or more."""
    return simhash.keep_first(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut out of the texts; documents that were nothing else go."""
    return _recount(docs, decontam.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return _recount(docs, secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces placed in sequences of 2048."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", remove_secrets),
    ("packing", pack),
]

#: Several stages have no SQL form; the pipeline is tested against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again, and its input deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = work_dir(spark)
        docs = materialize(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
