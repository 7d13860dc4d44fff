"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import holdout


def labels_of(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(_id, label) with label 0 or 1; of repeated labels the largest counts, null ids and labels are left out."""
    rows = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    return rows.where("_id is not null and label is not null").groupBy("_id").agg(F.max("label").alias("label"))


def first_by_hash(rows: DataFrame, group: str, n: int) -> DataFrame:
    """About the n rows of each group with the least (h, _id), never more. Each group is counted first; only rows whose hash lies
    below the share that n needs, and six standard deviations more, are ordered, so a hot group is no task's burden."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(group, "_group")
    share = F.col("h") / F.lit(2.0**64) + 0.5
    near = rows.join(counts, F.col(group).eqNullSafe(F.col("_group"))).where(share * F.col("_n") <= n + 6 * n**0.5 + 36).drop("_n", "_group")
    return near.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy("h", "_id"))).where(F.col("nth") <= n).drop("nth")


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """(id, text, label) of at most per_class rows of each class, chosen by a hash of the id among rows whose crc32(id) mod
    modulus is not held; and what each sampled row of a class stands for."""
    ids = docs.select(F.col(id_col).alias("_id")).where(holdout("_id", modulus) != held).distinct()
    known = labels_of(labels, label_col, id_col).join(ids, "_id", "left_semi").select("_id", "label", F.xxhash64("_id").alias("h"))
    counted = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    chosen = first_by_hash(known, "label", per_class).select("_id", "label")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    return rows.select(F.col("_id").alias("id"), "text", "label"), {k: n / min(n, per_class) for k, n in counted.items()}
