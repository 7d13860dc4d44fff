"""Queries through the library's own builders, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, exchange, joins, merge
from ..sources.tables import table
from ..streaming import windows


def rollup_chain(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P"))).withColumn("price", F.col("o_totalprice").cast("decimal(12,2)"))
    out = aggregates.rollup_chain(orders, ["status", "o_orderpriority"], n=("count", "o_orderkey"), total=("sum", "price"), hi=("max", "o_orderkey"), bits=("bit_xor", "o_orderkey"))
    return out.withColumn("total", F.col("total").cast("double"))


def salted_sum(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.salted_sum(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", "l_orderkey", 16)


def strategy(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        o, c = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
        return joins.join(o, c, o["o_custkey"] == c["c_custkey"], "inner", how).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))

    return run


#: A residual condition on top of the equality, in both engines.
RESIDUAL = "c_acctbal * 20 < o_totalprice"
JOINED = {"inner": "join", "left": "left join", "right": "right join", "full": "full join"}


def typed(how: str, strategy_: str) -> Callable[[SparkSession, str], DataFrame]:
    """orders with customers of a positive balance, by a join type under a strategy, with a residual condition."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
        if how == "existence":
            return joins.with_existence(o, c, "o_custkey", "c_custkey", "e", strategy_, F.expr(RESIDUAL)).select("o_orderkey", "e")
        out = joins.join(o, c, (o["o_custkey"] == c["c_custkey"]) & F.expr(RESIDUAL), how, strategy_)
        return out.select("o_orderkey") if how in ("semi", "anti") else out.select("o_orderkey", "c_custkey")

    return run


def typed_sql(how: str) -> str:
    match = f"select 1 from customer where c_custkey = o_custkey and c_acctbal > 0 and {RESIDUAL}"
    if how == "existence":
        return f"select o_orderkey, exists ({match}) as e from orders"
    if how in ("semi", "anti"):
        return f"select o_orderkey from orders where {'not ' * (how == 'anti')}exists ({match})"
    return f"select o_orderkey, c_custkey from orders {JOINED[how]} (select * from customer where c_acctbal > 0) c on o_custkey = c_custkey and {RESIDUAL}"


def planned(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.planned_join(o, c, "o_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def null_aware_anti(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(10)).alias("p_size"))
    sizes = table(spark, d, "lineitem").where("l_quantity > 45").select((F.col("l_quantity") % 50).cast("int").alias("k"))
    return joins.not_in(part, sizes, "p_size", "k").select("p_partkey")


def existence(spark: SparkSession, d: str) -> DataFrame:
    return joins.with_existence(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 250000"), "c_custkey", "o_custkey", "big_order")


def range_join(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.range(0, 20).select((F.col("id") * 2500).cast("double").alias("low"), (F.col("id") * 2500 + 3000).cast("double").alias("high"), F.col("id").alias("band"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return joins.range_join(rows, F.broadcast(bands), "l_extendedprice", "low", "high", 2500.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def partition_ids(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose partition after hash partitioning is the one that partition_id() says: all."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    dealt = exchange.hash_partition(c, 7, "c_custkey", "c_name").withColumn("at", F.spark_partition_id()).withColumn("said", exchange.partition_id(7, "c_custkey", "c_name"))
    return dealt.groupBy((F.col("at") == F.col("said")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return exchange.round_robin(table(spark, d, "orders"), 5).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def range_parts(spark: SparkSession, d: str) -> DataFrame:
    """The ranges of a range partitioning don't overlap."""
    o = exchange.range_partition(table(spark, d, "orders").select("o_orderkey"), 4, "o_orderkey").withColumn("p", F.spark_partition_id())
    spans = o.groupBy("p").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s"))
    return spans.select("n", F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("s", i)["b"] < F.element_at("s", i + 1)["a"]).alias("ordered"))


def rebalance(spark: SparkSession, d: str) -> DataFrame:
    return exchange.rebalance(table(spark, d, "lineitem"), "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def expand_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("a"), F.sum_distinct(F.col("o_custkey") % 10).alias("b"), F.count_distinct("o_orderpriority", "o_custkey").alias("c"))


def cached(spark: SparkSession, d: str) -> DataFrame:
    """A cached relation that is read twice; the cache goes with the next clearCache() of the session."""
    df = table(spark, d, "supplier").select("s_nationkey", "s_suppkey").cache()
    return df.groupBy("s_nationkey").agg(F.max("s_suppkey").alias("m"))


def computed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Hash partitioning on a computed key: the rows of a key lie in one partition."""
    key = F.col("o_custkey") % 97
    dealt = exchange.hash_partition(table(spark, d, "orders").select("o_custkey"), 6, key).select(key.alias("k"), F.spark_partition_id().alias("p"))
    return dealt.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("parts"))


def hash_sampled(spark: SparkSession, d: str) -> DataFrame:
    return exchange.hash_sample(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), 0.1, "l_orderkey", "l_linenumber")


def window_whole(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return aggregates.with_totals(part, ["p_brand"], hi=F.max("p_retailprice"), n=F.count(F.lit(1))).select("p_partkey", "hi", "n")


def percentile(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    q = aggregates.percentiles(orders, ["o_orderstatus"], "o_totalprice", q1=0.25, m=0.5)
    q = q.select("o_orderstatus", F.round("q1", 4).alias("q1"), F.round("m", 4).alias("m"))
    return q.join(aggregates.modes(orders, ["o_orderstatus"], "o_orderpriority", "mo"), "o_orderstatus")


def monotonic(spark: SparkSession, d: str) -> DataFrame:
    """Ids rise within a partition and hold its number in the high bits."""
    rows = table(spark, d, "orders").repartition(5, "o_custkey").select(F.monotonically_increasing_id().alias("i"), F.spark_partition_id().alias("p"))
    spans = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_distinct("i").alias("d"))
    return spans.agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.bool_and((F.shiftright("lo", 33) == F.col("p")) & (F.col("hi") - F.col("lo") == F.col("n") - 1)).alias("dense"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"], n=F.count(F.lit(1))).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def event_hops(spark: SparkSession, d: str) -> DataFrame:
    out = windows.windowed(table(spark, d, "events"), "ts", "1 day", ["event_type"], slide="12 hours", n=F.count(F.lit(1)))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def values(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("select * from values (1, 'a', 1.5D), (2, null, -0.5D), (null, 'c', 0D) as t(i, s, x)")


def ranges(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(3, 100, 7).select("id", (F.col("id") * F.col("id")).alias("sq"))


def coalesced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").coalesce(1).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Target and source by what the rows hold; some customers are in both."""
    rows = table(spark, d, "customer")
    target = rows.where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("k"))
    source = rows.where("c_acctbal > 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), (F.col("c_nationkey") + 100).cast("long").alias("k"))
    return target, source


def merge_rows(spark: SparkSession, d: str) -> DataFrame:
    target, source = _changes(spark, d)
    s = {c: F.col(f"s.{c}") for c in target.columns}
    return merge.merged(target, source, ["c_custkey"], [
        merge.Clause("matched", "discard", F.col("s.k") < 105), merge.Clause("matched", "keep", F.col("s.k") < 112, {"c_name": s["c_name"]}), merge.Clause("matched", "split", None, s),
        merge.Clause("not_matched", "keep", F.col("s.k") > 102, s), merge.Clause("not_matched_by_source", "discard", F.col("t.k") == 3),
    ])


def deletes(spark: SparkSession, d: str) -> DataFrame:
    """Positional, vector and equality deletes in turn."""
    data = table(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("file"), F.floor(F.col("o_orderkey") / 4).alias("pos"), "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"), F.lit(1).alias("seq"))
    positions = data.where("o_orderkey % 11 = 0").select("file", "pos")
    vectors = data.where("o_orderkey % 13 = 0").groupBy("file").agg(F.collect_list("pos").alias("positions"))
    equal = spark.sql("select * from values (cast(null as string), 2), ('1-URGENT', 1) as t(p, seq)")
    left = merge.delete_positions(merge.delete_positions(data, positions), merge.expand_vector(vectors))
    return merge.delete_equal(left, equal, ["p"], "seq").select("o_orderkey")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def sample(spark: SparkSession, d: str) -> DataFrame:
    """Bernoulli sampling by a seed: Spark's own rows, so there is no SQL for it."""
    return table(spark, d, "lineitem").sample(False, 0.1, 42).select("l_orderkey", "l_linenumber")


BUILDERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "rollup_chain": (rollup_chain, """
        select nullif(o_orderstatus, 'P') as status, o_orderpriority, cast(grouping_id(nullif(o_orderstatus, 'P'), o_orderpriority) as bigint) as grouping_id, count(o_orderkey) as n,
               cast(sum(cast(o_totalprice as decimal(12,2))) as double) as total, max(o_orderkey) as hi, bit_xor(o_orderkey) as bits from orders group by rollup(nullif(o_orderstatus, 'P'), o_orderpriority)"""),
    "salted_sum": (salted_sum, "select l_returnflag, cast(sum(l_orderkey) as bigint) as sum, count(l_orderkey) as count from lineitem group by 1"),
    **{f"join_{k}": (strategy(k), "select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey group by 1") for k in ("broadcast", "hash", "merge")},
    **{f"join_{how}_{k}": (typed(how, k), typed_sql(how)) for how in ("inner", "left", "right", "full", "semi", "anti", "existence") for k in ("broadcast", "hash", "merge") if (how, k) != ("full", "broadcast")},
    "exchange_computed_keys": (computed_keys, "select o_custkey % 97 as k, count(*) as n, cast(1 as bigint) as parts from orders group by 1"),
    "sample_hash": (hash_sampled, "select l_orderkey, l_linenumber from lineitem where substr(md5(l_orderkey || '|' || l_linenumber), 1, 4) < '199a'"),
    "window_whole": (window_whole, "select p_partkey, max(p_retailprice) over (partition by p_brand) as hi, count(*) over (partition by p_brand) as n from part"),
    "agg_percentile": (percentile, "select o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(median(o_totalprice), 4) as m, (select p from (select o_orderpriority p, count(*) c from orders o2 where o2.o_orderstatus = orders.o_orderstatus group by 1) order by c desc, p desc limit 1) as mo from orders group by o_orderstatus"),
    "monotonic_ids": (monotonic, "select count(*) as n, count(*) as d, true as dense from orders"),
    "event_sessions": (event_sessions, """
        select user_id, min(ts) as start, count(*) as n from (
            select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (
                select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hours then 0 else 1 end as new from events) e) t
        group by user_id, s"""),
    "event_hops": (event_hops, "select event_type, to_timestamp(floor(epoch(ts) / 43200) * 43200 - i * 43200)::timestamp as start, count(*) as n from events, range(0, 2) r(i) group by 1, 2"),
    "join_planned": (planned, "select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey group by 1"),
    "join_null_aware_anti": (null_aware_anti, "select p_partkey from (select p_partkey, nullif(p_size, 10) as s from part) t where s not in (select cast(trunc(l_quantity % 50) as int) from lineitem where l_quantity > 45)"),
    "join_existence": (existence, "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000) as big_order from customer"),
    "join_range": (range_join, "select i as band, count(*) as n from lineitem, range(0, 20) r(i) where l_extendedprice >= i * 2500 and l_extendedprice < i * 2500 + 3000 group by 1"),
    "exchange_hash": (partition_ids, "select true as same, count(*) as n from customer"),
    "exchange_round_robin": (round_robin, "select o_orderstatus, count(*) as n from orders group by 1"),
    "exchange_range": (range_parts, "select count(*) as n, true as ordered from orders"),
    "exchange_rebalance": (rebalance, "select l_returnflag, count(*) as n from lineitem group by 1"),
    "expand_distinct": (expand_distinct, "select o_orderstatus, count(distinct o_custkey) as a, cast(sum(distinct o_custkey % 10) as bigint) as b, count(distinct (o_orderpriority, o_custkey)) as c from orders group by 1"),
    "scan_cached": (cached, "select s_nationkey, max(s_suppkey) as m from supplier group by 1"),
    "scan_values": (values, "select * from (values (1, 'a', 1.5::double), (2, null, -0.5::double), (null, 'c', 0::double)) t(i, s, x)"),
    "scan_range": (ranges, "select range as id, range * range as sq from range(3, 100, 7)"),
    "coalesce_partitions": (coalesced, "select c_mktsegment, count(*) as n from customer group by 1"),
    "merge_into": (merge_rows, """
        with t as (select c_custkey, c_name, cast(c_nationkey as bigint) as k from customer where c_mktsegment <> 'BUILDING'),
             s as (select c_custkey, 'new ' || c_name as c_name, cast(c_nationkey + 100 as bigint) as k from customer where c_acctbal > 0)
        select t.c_custkey, case when s.k < 112 then s.c_name when s.k is null then t.c_name else s.c_name end as c_name, case when s.k is null or s.k < 112 then t.k else s.k end as k
        from t left join s using (c_custkey) where not coalesce(s.k < 105, false) and not (s.k is null and t.k = 3)
        union all select * from s where k > 102 and c_custkey not in (select c_custkey from t)"""),
    "deletes_on_read": (deletes, "select o_orderkey from orders where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and o_orderpriority <> '5-LOW'"),
    "sample_rows": (sample, ""),
    "event_windows": (event_windows, "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n from events group by 1, 2"),
}
