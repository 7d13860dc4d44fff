"""MERGE semantics over DataFrames: ordered clauses, split updates, cardinality; and deletes applied on read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .joins import broadcast_if_small


@dataclass
class Clause:
    """when: matched, not_matched or not_matched_by_source; action: keep (update or insert), split (delete and insert) or
    discard. set gives output columns as expressions over t.* and s.*; columns left out keep the target's value."""

    when: str
    action: str
    condition: Column | None = None
    set: dict[str, Column] = field(default_factory=dict)


def merge(target: DataFrame, source: DataFrame, on: list[str], clauses: list[Clause], check: bool | None = None) -> DataFrame:
    """The target after the merge, with a column `_op` (keep, update, insert, delete). The first clause of a row's group whose
    condition is true decides (null counts as false); rows that no clause claims stay if they are the target's and go if
    they are the source's. A target row that several source rows match raises, unless the check is off."""
    if check is None:
        check = config.get(target.sparkSession, "merge.checkCardinality")
    columns = target.columns
    t = target.select(F.struct(*columns).alias("t"), *(F.col(c).alias(f"_t_{c}") for c in on), F.lit(True).alias("_in_t"))
    s = source.select(F.struct(*source.columns).alias("s"), *(F.col(c).alias(f"_s_{c}") for c in on), F.lit(True).alias("_in_s"))
    if check:
        # By the keys of the join that follows: no exchange of its own. Two rows tell, so a hot key's rows needn't be counted.
        keys = [f"_s_{c}" for c in on]
        s = s.withColumn("_twice", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) > 1)
        fault = F.raise_error(F.lit("MERGE_CARDINALITY_VIOLATION: a target row matches several source rows"))
        guard = F.when(F.col("_twice") & F.col("_in_t"), fault.cast("boolean")).otherwise(F.lit(True))
    else:
        guard = F.lit(True)
    keys = [F.col(f"_t_{c}") == F.col(f"_s_{c}") for c in on]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    both = t.join(s, condition, "full_outer")
    in_t, in_s = F.coalesce("_in_t", F.lit(False)), F.coalesce("_in_s", F.lit(False))
    groups = {"matched": in_t & in_s, "not_matched": ~in_t & in_s, "not_matched_by_source": in_t & ~in_s}

    def row(op: str, values: dict[str, Column] | None = None) -> Column:
        values = values or {}
        return F.struct(F.lit(op).alias("_op"), *(values.get(c, F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) for c in columns))

    def outputs(c: Clause) -> Column:
        if c.action == "discard":
            return F.array(row("delete"))
        made = row("insert" if c.when == "not_matched" else "update", c.set)
        return F.array(row("delete"), F.struct(F.lit("insert").alias("_op"), *(c.set.get(x, F.col(f"t.{x}")).cast(target.schema[x].dataType).alias(x) for x in columns))) if c.action == "split" else F.array(made)

    decided = None
    for c in clauses:
        holds = groups[c.when] & (F.coalesce(c.condition, F.lit(False)) if c.condition is not None else F.lit(True))
        decided = F.when(holds, outputs(c)) if decided is None else decided.when(holds, outputs(c))
    unclaimed = F.when(in_t, F.array(row("keep")))
    made = decided.otherwise(unclaimed) if decided is not None else unclaimed
    return both.where(guard).select(F.explode(made).alias("o")).select("o.*")


def merged(target: DataFrame, source: DataFrame, on: list[str], clauses: list[Clause], check: bool | None = None) -> DataFrame:
    """The rows that the target holds after the merge."""
    return merge(target, source, on, clauses, check).where("_op <> 'delete'").drop("_op")


def delete_positions(data: DataFrame, deletes: DataFrame, file_col: str = "file", pos_col: str = "pos") -> DataFrame:
    """Rows without those that a positional delete or a deletion vector names by (file, position)."""
    d = broadcast_if_small(deletes.select(F.col(file_col).alias("_f"), F.col(pos_col).alias("_p")))
    return data.join(d, (data[file_col] == F.col("_f")) & (data[pos_col] == F.col("_p")), "left_anti")


def delete_equal(data: DataFrame, deletes: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Rows without those that an equality delete names: null equals null, and only data older than the delete goes."""
    d = deletes.select(*(F.col(k).alias(f"_d_{k}") for k in keys), *([F.col(sequence).alias("_d_seq")] if sequence else []))
    condition = F.lit(True)
    for k in keys:
        condition = condition & data[k].eqNullSafe(F.col(f"_d_{k}"))
    if sequence:
        condition = condition & (data[sequence] < F.col("_d_seq"))
    return data.join(d, condition, "left_anti")


def expand_vector(vectors: DataFrame, file_col: str = "file", bits_col: str = "positions") -> DataFrame:
    """Deletion vectors (file, array of positions) as positional deletes."""
    return vectors.select(file_col, F.explode(bits_col).alias("pos"))
