"""Connected components by alternating large and small stars, each round a few shuffled joins and a checkpoint."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, frugal


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task keeps a spanning forest of its own edges."""

    def run(batches):
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = [x for x in up if root(x) != x]
        kinds = [edges_type, edges_type]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], kinds[0]), pa.array(nodes, kinds[1])], ["a", "b"])

    from pyspark.sql.pandas.types import to_arrow_type

    edges_type = to_arrow_type(edges.schema["a"].dataType)
    return edges.select("a", "b").mapInArrow(frugal(run), edges.select("a", "b").schema)


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its smallest node. Nulls are left out.
    The number of rounds grows with the logarithm of the nodes; most_rounds only stops a fault."""
    e = forest(edges.where("a is not null and b is not null and a <> b"))
    e = checkpointed(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        seen = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if tuple(seen) == mark:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        mark = tuple(seen)
        # Large star: every larger neighbour of a node meets the least of the node and its neighbours.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        e = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        # Small star: a node and its smaller neighbours meet the least of these.
        least = e.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        near = e.join(least, F.col("b") == F.col("u"))
        e = near.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        e = checkpointed(e)
    raise RuntimeError("components did not settle")
