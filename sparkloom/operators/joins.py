"""Joins: strategies, residual and theta conditions, NOT IN, existence, and the choice between hash and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config

#: Build sides that each join type allows.
BUILD_SIDES = {"inner": ("right", "left"), "cross": ("right", "left"), "left": ("right", "left"), "right": ("left", "right"), "full": ("right", "left"), "semi": ("right",), "anti": ("right",), "existence": ("right",)}
HINTS = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast", "nested": "shuffle_replicate_nl"}
#: Bytes that a row's entry in a hash table takes beside the row.
ENTRY = 32
#: Types whose values lie in the eight bytes of their field, but for decimals.
FLAT = (T.NumericType, T.BooleanType, T.DatetimeType, T.AnsiIntervalType, T.NullType)


KINDS = {"leftouter": "left", "rightouter": "right", "outer": "full", "fullouter": "full", "left_semi": "semi", "left_anti": "anti", "leftsemi": "semi", "leftanti": "anti"}


def kind_of(how: str) -> str:
    plain = how.replace("_outer", "outer")
    return KINDS.get(plain, plain)


def built_bytes(df: DataFrame) -> int:
    """Bytes of df's rows in a hash table, by a pass that counts them: the optimizer only knows how large their files are, packed."""
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    each = F.lit(ENTRY + 8 + 8 * len(plain.columns)).cast("long")
    for f in plain.schema:
        if isinstance(f.dataType, T.DecimalType) or not isinstance(f.dataType, FLAT):
            each = each + F.coalesce(F.octet_length(F.col(f.name).cast("string")) + 7, F.lit(0))
    return plain.agg(F.sum(each)).first()[0] or 0


def affordable(built: DataFrame, strategy: str | None) -> str | None:
    """strategy, but merge for broadcast if the side to be built, counted first, is beyond broadcast.maxBytes: the driver and
    every executor would hold it whole."""
    if strategy != "broadcast" or built.isStreaming or built_bytes(built) <= config.get(built.sparkSession, "broadcast.maxBytes"):
        return strategy
    return "merge"


def join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """A join with an optional strategy (hash, merge, broadcast or nested) for the side that the join type lets be built. A side
    that is too large to be broadcast is merged; an outer, semi or anti join without an equality can't be, and Spark broadcasts."""
    kind = kind_of(how)
    if strategy == "broadcast" and kind == "full":
        raise ValueError("no side of a full join can be broadcast")
    return hinted(left, right, on, how, affordable(left if BUILD_SIDES.get(kind, ("right",))[0] == "left" else right, strategy))


def hinted(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str, strategy: str | None) -> DataFrame:
    """join() by a strategy that is known to be affordable."""
    if strategy is None:
        return left.join(right, on, how)
    if BUILD_SIDES[kind_of(how)][0] == "left":
        return left.hint(HINTS[strategy]).join(right, on, how)
    return left.join(right.hint(HINTS[strategy]), on, how)


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """df with a broadcast hint if the optimizer knows it to be small enough; as it is otherwise."""
    most = max_bytes if max_bytes is not None else config.get(df.sparkSession, "broadcast.maxBytes")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows whose key is NOT IN the right column, with SQL's three cases: an empty right side keeps all rows, also null keys;
    a null on the right keeps none; else null keys and matches go."""
    keys = right.select(F.col(right_key).alias("_k"))
    flags = keys.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_k").isNull()).alias("_nulls"))
    kept = left.join(keys.where("_k is not null"), left[left_key] == F.col("_k"), "left_anti")
    return kept.crossJoin(F.broadcast(flags)).where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(left_key).isNotNull())).drop("_n", "_nulls")


def with_existence(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "exists", strategy: str | None = None, residual: Column | None = None) -> DataFrame:
    """Every left row, and whether its key occurs on the right (in a row for which residual holds, if given): never null.
    A residual names columns of both sides; left rows are told apart by all their columns."""
    if residual is None:
        keys = right.select(F.col(right_key).alias("_k")).where("_k is not null").distinct()
        return join(left, keys, left[left_key] == F.col("_k"), "left", strategy).withColumn(name, F.col("_k").isNotNull()).drop("_k")
    strategy = affordable(right, strategy)
    hits = hinted(left, right, (left[left_key] == right[right_key]) & residual, "semi", strategy).withColumn(name, F.lit(True))
    misses = hinted(left, right, (left[left_key] == right[right_key]) & residual, "anti", strategy).withColumn(name, F.lit(False))
    return hits.unionByName(misses)


#: Buckets of a level that one interval covers at most; wider intervals go to a level of wider buckets.
FAN_OUT, LEVELS = 64, 9


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """low <= point < high, by buckets of the given width: an equi-join on the bucket, then the exact condition. An interval of
    more than FAN_OUT buckets is dealt by buckets FAN_OUT times as wide, and so on, so none becomes more than FAN_OUT + 1 rows;
    a point is looked up once on each level that occurs (at most LEVELS + 1; beyond that, by the widest buckets)."""
    if width <= 0:
        raise ValueError("width must be positive")
    level = F.least(F.greatest(F.ceil(F.log(float(FAN_OUT), F.greatest((F.col(high) - F.col(low)) / width, F.lit(1.0)))) - 1, F.lit(0)), F.lit(LEVELS)).cast("int")
    spans = right.withColumn("_level", F.coalesce(level, F.lit(0)))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect()) or [0]  # at most LEVELS + 1 numbers
    size = F.lit(float(width)) * F.pow(F.lit(float(FAN_OUT)), F.col("_level"))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    if how != "inner" and len(levels) > 1:
        raise ValueError("outer range joins need intervals of one level: choose a width near the widest interval's")
    points = left.withColumn("_on", F.explode(F.array(*map(F.lit, levels)))) if len(levels) > 1 else left.withColumn("_on", F.lit(levels[0]))
    points = points.withColumn("_at", F.floor(F.col(point) / (F.lit(float(width)) * F.pow(F.lit(float(FAN_OUT)), F.col("_on")))))
    on = (F.col("_at") == F.col("_bucket")) & (F.col("_on") == F.col("_level")) & (F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))
    return points.join(spans, on, how).drop("_bucket", "_at", "_on", "_level")


def decide_join(order_visible: bool, order_required: bool, build_bytes: dict[str, int], tasks: int, how: str = "inner", mode: str = "auto", spill_bytes: int = 256 << 20, cap_factor: int = 32) -> tuple[str, str | None, str]:
    """('hash' | 'merge', build side, reason) for an equi-join planned as a sort-merge join.

    A visible order is kept by merging. Else the smaller allowed side is hashed if a task's share of it is below
    spill_bytes, or may spill below cap_factor times that; larger sides are merged. A side larger than the other is never
    built. mode forces one of the two where it is possible, or 'off' leaves the plan alone."""
    if mode not in ("off", "hash", "merge", "auto"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode in ("off", "merge"):
        return "merge", None, f"mode {mode}"
    if order_required or (order_visible and mode != "hash"):
        return "merge", None, "the order of the rows is visible above"
    other = {"left": "right", "right": "left"}
    sides = [s for s in BUILD_SIDES[how] if build_bytes[s] <= build_bytes[other[s]]]
    if not sides:
        return "merge", None, "the side that could be built is the larger one"
    side = min(sides, key=lambda s: build_bytes[s])
    share = build_bytes[side] / max(tasks, 1)
    if mode == "hash" or share <= spill_bytes:
        return "hash", side, "the build side fits"
    if share <= cap_factor * spill_bytes:
        return "hash", side, "the build side spills within its cap"
    return "merge", None, "the build side is beyond its cap"


def planned_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", order_visible: bool = False) -> DataFrame:
    """join() with the strategy of decide_join() on the optimizer's sizes."""
    spark = left.sparkSession
    size = lambda d: int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    kind = kind_of(how)
    choice, side, _ = decide_join(order_visible, False, {"left": size(left), "right": size(right)}, int(spark.conf.get("spark.sql.shuffle.partitions")), kind, config.get(spark, "join.mode"), config.get(spark, "join.spillBytes"), config.get(spark, "join.capFactor"))
    if choice == "merge":
        return left.join(right.hint("merge"), on, how)
    return left.hint("shuffle_hash").join(right, on, how) if side == "left" else left.join(right.hint("shuffle_hash"), on, how)
