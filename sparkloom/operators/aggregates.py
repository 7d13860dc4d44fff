"""Aggregates beyond one groupBy: nested grouping sets as a chain, two-step sums over hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config

#: Aggregates whose parts merge: name -> (parts, how each part merges, result from the parts).
PARTS = {
    "sum": (lambda c: {"s": F.sum(c)}, {"s": F.sum}, lambda p: p["s"]),
    "count": (lambda c: {"n": F.count(c)}, {"n": F.sum}, lambda p: p["n"]),
    "min": (lambda c: {"m": F.min(c)}, {"m": F.min}, lambda p: p["m"]),
    "max": (lambda c: {"m": F.max(c)}, {"m": F.max}, lambda p: p["m"]),
    "avg": (lambda c: {"s": F.sum(c), "n": F.count(c)}, {"s": F.sum, "n": F.sum}, lambda p: F.try_divide(p["s"], p["n"])),
    "bit_and": (lambda c: {"b": F.bit_and(c)}, {"b": F.bit_and}, lambda p: p["b"]),
    "bit_or": (lambda c: {"b": F.bit_or(c)}, {"b": F.bit_or}, lambda p: p["b"]),
    "bit_xor": (lambda c: {"b": F.bit_xor(c)}, {"b": F.bit_xor}, lambda p: p["b"]),
    "bool_and": (lambda c: {"b": F.bool_and(c)}, {"b": F.bool_and}, lambda p: p["b"]),
    "bool_or": (lambda c: {"b": F.bool_or(c)}, {"b": F.bool_or}, lambda p: p["b"]),
}


def rollup_chain(df: DataFrame, keys: list[str], **aggs: tuple[str, str | Column]) -> DataFrame:
    """ROLLUP(keys) with aggregates name=(function, column): the finest set is aggregated once from the rows, each coarser
    one is merged from the one before it. Adds grouping_id (as SQL's), so that a null key stays apart from a rolled-up one.
    Only functions in PARTS merge; for others use df.rollup(). Double sums associate differently than in one pass. With the
    setting rollup.chain off, it is one plain rollup."""
    unknown = {f for f, _ in aggs.values()} - set(PARTS)
    if unknown:
        raise ValueError(f"not mergeable: {sorted(unknown)}")
    if not config.get(df.sparkSession, "rollup.chain"):
        whole = {name: (f, F.col(c) if isinstance(c, str) else c) for name, (f, c) in aggs.items()}
        return df.rollup(*keys).agg(F.grouping_id().cast("long").alias("grouping_id"), *(getattr(F, "try_avg" if f == "avg" else f)(c).alias(name) for name, (f, c) in whole.items()))
    parts, merge = [], []
    for name, (f, column) in aggs.items():
        make, how, _ = PARTS[f]
        for part, c in make(F.col(column) if isinstance(column, str) else column).items():
            parts.append(c.alias(f"_{name}_{part}"))
            merge.append((how[part], f"_{name}_{part}"))
    level = df.groupBy(*keys).agg(*parts)
    levels = []
    for k in range(len(keys), -1, -1):
        if k < len(keys):
            level = level.groupBy(*keys[:k]).agg(*(f(c).alias(c) for f, c in merge))
        result = [PARTS[f][2]({p: F.col(f"_{name}_{p}") for p in PARTS[f][1]}).alias(name) for name, (f, _) in aggs.items()]
        shown = [F.col(c) if i < k else F.lit(None).cast(df.schema[c].dataType).alias(c) for i, c in enumerate(keys)]
        levels.append(level.select(*shown, F.lit((1 << (len(keys) - k)) - 1).cast("long").alias("grouping_id"), *result))
    return reduce(DataFrame.unionByName, levels)


def with_totals(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """df with aggregates of each row's whole group: what a window over the whole partition gives, by an aggregate with
    map-side partial sums and a null-safe join, so that a hot group is not one task's."""
    named = [f"_key_{k}" for k in keys]
    groups = df.groupBy(*keys).agg(*(c.alias(name) for name, c in aggs.items())).withColumnsRenamed(dict(zip(keys, named)))
    return df.join(groups, [df[k].eqNullSafe(F.col(n)) for k, n in zip(keys, named)]).drop(*named)


def percentiles(df: DataFrame, keys: list[str], value: str, **points: float) -> DataFrame:
    """Exact percentiles of a group, linearly interpolated, without a buffer of its values: values are counted first, with partial
    sums on the map side, and only distinct values are ordered. Null values don't count; a group of nulls gets null."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.when(F.col(value).isNull(), 0).otherwise(F.col("_n")))
    by = Window.partitionBy(*keys)
    upto = counted.withColumn("_upto", F.sum("_n").over(by.orderBy(F.col(value).asc_nulls_first()))).withColumn("_all", F.sum("_n").over(by))
    out = []
    for name, p in points.items():
        if not 0 <= p <= 1:
            raise ValueError("percentiles lie in [0, 1]")
        place = F.lit(float(p)) * (F.col("_all") - 1)
        at = lambda k: F.min(F.when((F.col("_upto") > k) & (F.col("_n") > 0), F.col(value)))
        low, high, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(name))
    return upto.groupBy(*keys).agg(*out)


def modes(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group, of equals the largest; from counts, with partial sums on the map side."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", value)).alias(name))


def salted_sum(df: DataFrame, key: str, value: str, n: int = 32) -> DataFrame:
    """Exact sums and counts by a key that may be hot, in two steps: by (key, salt), then by key."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    return df.groupBy(key, salt.alias("_salt")).agg(F.sum(value).alias("s"), F.count(value).alias("n")).groupBy(key).agg(F.sum("s").alias("sum"), F.sum("n").alias("count"))
