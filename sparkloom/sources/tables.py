"""Readers, writers and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CORE = "region nation customer supplier part orders lineitem events".split()
ALL = [*CORE, *"documents embeddings pages benchmark labels conversations".split()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views of the tables, by name."""
    for name in ALL if names is None else names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read(spark: SparkSession, kind: str, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """parquet, orc, csv, json, text or avro; text formats need a schema, so that no pass is spent on guessing one."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None and kind != "text" else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table_name: str, column: str, lower: int, upper: int, parts: int, **options) -> DataFrame:
    """A JDBC table in `parts` ranges of a numeric column, so that no single task reads it all."""
    return spark.read.format("jdbc").options(url=url, dbtable=table_name, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()


def write(df: DataFrame, kind: str, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> None:
    """A table bucketed and sorted by keys: later joins and aggregates on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def values(spark: SparkSession, schema: T.StructType | str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
