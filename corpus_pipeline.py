"""A corpus pipeline of five stages, each of which calls one operator of sparkloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; only the rows that a stage rejects go.

Defined results: null and empty texts have no language and go in the first stage; of rows that repeat, one stays after the
second; rows with a null id stay where they repeat no text, link with nothing, and are scored like others; an empty table
gives none; extra columns, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, exact_dedup, language_id, ngram_join, sentencepiece_bpe
from sparkloom.llm.common import let_go, read_table, shared_folder
from sparkloom.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be recognised (no letter, or no text) go."""
    return language_id.with_language(docs, language_id.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links tie together (4-word shingles, Jaccard 0.85), the one with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-filled or not, go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return sentencepiece_bpe.encode_documents(docs, tokenizer_file(spark, "piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("decontamination", benchmark),
    ("sentencepiece", encode),
]
#: Two stages (a trained network, byte-pair encoding) can't be said in SQL.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; between them, Parquet in the shared folder that spark.checkpoint.dir names. A stage's rows are removed when
    the next one's are written; those of the last are the result and stay."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        let_go(spark)
    return docs
