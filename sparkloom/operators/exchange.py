"""Partitioning: hash, range, round robin, single, rebalance; and the partition that a row goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_id(n: int, *keys: str | Column) -> Column:
    """The partition to which hash partitioning on keys into n sends a row."""
    return F.pmod(F.hash(*keys), F.lit(n))


def hash_partition(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    return df.repartition(n, *keys)


def range_partition(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    return df.repartitionByRange(n, *keys)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def single(df: DataFrame) -> DataFrame:
    """One partition: for small results only."""
    return df.coalesce(1)


def rebalance(df: DataFrame, *keys: str) -> DataFrame:
    """Partitions of about the advisory size; large ones are split, small ones joined, at run time."""
    return df.hint("rebalance", *keys)


def salted(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Adds `salt` in [0, n), from a hash of the whole row, to split hot keys before a two-step aggregate."""
    return df.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int"))


def hash_sample(df: DataFrame, fraction: float, *keys: str) -> DataFrame:
    """Rows whose keys' MD5 falls into the fraction (in steps of 1/65536): the same rows on any engine and partitioning."""
    name = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return df.where(F.substring(F.md5(name), 1, 4) < F.lit(f"{min(65536, round(fraction * 65536)):04x}") if fraction < 1 else F.lit(True))
