"""Operators on small fixtures: nulls, empty sides, refusals, and plan shapes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.operators import aggregates, exchange, joins, merge
from sparkloom.plans import report
from sparkloom.sources import tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_not_in_three_cases(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(joins.not_in(left, spark.createDataFrame([], "k int"), "k", "k")) == [(1,), (2,), (None,)]
    assert rows(joins.not_in(left, spark.createDataFrame([(1,)], "k int"), "k", "k")) == [(2,)]
    assert rows(joins.not_in(left, spark.createDataFrame([(1,), (None,)], "k int"), "k", "k")) == []


def test_existence_is_never_null(spark):
    left = spark.createDataFrame([(1,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(joins.with_existence(left, right, "k", "k")) == [(1, True), (None, False)]


@pytest.mark.parametrize(
    "args, want",
    [
        ((False, False, {"left": 100, "right": 10}, 1), ("hash", "right")),
        ((True, False, {"left": 100, "right": 10}, 1), ("merge", None)),
        ((False, False, {"left": 10, "right": 100}, 1), ("hash", "left")),
        ((False, False, {"left": 10, "right": 100}, 1, "semi"), ("merge", None)),
        ((False, False, {"left": 1 << 40, "right": 1 << 36}, 1), ("merge", None)),
        ((False, False, {"left": 1 << 40, "right": 1 << 36}, 1000), ("hash", "right")),
        ((False, False, {"left": 100, "right": 10}, 1, "inner", "merge"), ("merge", None)),
        ((True, False, {"left": 100, "right": 10}, 1, "inner", "hash"), ("hash", "right")),
    ],
)
def test_decide_join(args, want):
    assert joins.decide_join(*args)[:2] == want


def test_decide_join_refuses_unknown_modes():
    with pytest.raises(ValueError):
        joins.decide_join(False, False, {"left": 1, "right": 1}, 1, mode="x")


def test_strategies_in_plans(spark):
    o, c = tables.table(spark, SF, "orders"), tables.table(spark, SF, "customer")
    for strategy, node in (("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin")):
        df = joins.join(o, c, o["o_custkey"] == c["c_custkey"], "inner", strategy)
        df.count()
        assert report.operators(df)[node] == 1


def test_rollup_chain_keeps_null_keys_apart(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "y", 2), ("a", None, 3)], "k string, j string, v int")
    got = rows(aggregates.rollup_chain(df, ["k", "j"], s=("sum", "v"), m=("avg", "v")))
    want = rows(df.rollup("k", "j").agg(F.grouping_id().alias("grouping_id"), F.sum("v").alias("s"), F.avg("v").alias("m")))
    assert got == want
    with pytest.raises(ValueError):
        aggregates.rollup_chain(df, ["k"], s=("median", "v"))


def test_rollup_chain_aggregates_the_rows_once(spark):
    df = aggregates.rollup_chain(tables.table(spark, SF, "lineitem"), ["l_returnflag", "l_linestatus"], n=("count", "l_orderkey"))
    df.collect()
    assert all("l_returnflag" in s and "l_comment" not in s for s in report.read_schemas(df))


def clauses():
    s = {"id": F.col("s.id"), "v": F.col("s.v")}
    return [merge.Clause("matched", "discard", F.col("s.v") < 0), merge.Clause("matched", "split", F.col("s.v") > 100, s), merge.Clause("matched", "keep", None, {"v": F.col("s.v")}), merge.Clause("not_matched", "keep", F.col("s.v") > 0, s)]


def test_merge(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "id int, v int")
    s = spark.createDataFrame([(1, -1), (2, 200), (3, None), (5, 5), (6, -6)], "id int, v int")
    assert rows(merge.merged(t, s, ["id"], clauses())) == [(2, 200), (3, None), (4, 40), (5, 5)]
    ops = merge.merge(t, s, ["id"], clauses()).groupBy("_op").count()
    assert dict(rows(ops)) == {"delete": 2, "insert": 2, "update": 1, "keep": 1}


def test_merge_cardinality(spark):
    t = spark.createDataFrame([(1, 10)], "id int, v int")
    s = spark.createDataFrame([(1, 1), (1, 2), (7, 1), (7, 2)], "id int, v int")
    with pytest.raises(Exception, match="CARDINALITY"):
        merge.merged(t, s, ["id"], clauses()).collect()
    assert merge.merged(t, s, ["id"], clauses(), check=False).count() == 4


def test_deletes(spark):
    data = spark.createDataFrame([("f", 0, None, 1), ("f", 1, "a", 1), ("g", 0, "b", 1), ("g", 1, "b", 3)], "file string, pos long, k string, seq int")
    assert merge.delete_positions(data, spark.createDataFrame([("f", 1)], "file string, pos long")).count() == 3
    vectors = merge.expand_vector(spark.createDataFrame([("f", [1])], "file string, positions array<long>"))
    assert rows(merge.delete_positions(data, vectors)) == rows(merge.delete_positions(data, spark.createDataFrame([("f", 1)], "file string, pos long")))
    gone = merge.delete_equal(data, spark.createDataFrame([(None, 2), ("b", 2)], "k string, seq int"), ["k"], "seq")
    assert rows(gone) == [("f", 1, "a", 1), ("g", 1, "b", 3)]


def test_partition_id(spark):
    df = exchange.hash_partition(spark.range(1000), 13, "id").select((F.spark_partition_id() == exchange.partition_id(13, "id")).alias("ok"))
    assert df.where("not ok").count() == 0


def test_range_join_equals_nested_loops(spark):
    points = spark.range(200).select((F.col("id") * 1.7).alias("x"))
    spans = spark.createDataFrame([(0.0, 10.0), (5.5, 5.5), (9.0, 200.0), (-3.0, 1.7)], "lo double, hi double")
    want = points.join(spans, (F.col("lo") <= F.col("x")) & (F.col("x") < F.col("hi")))
    assert rows(joins.range_join(points, spans, "x", "lo", "hi", 7.0)) == rows(want)
    with pytest.raises(ValueError):
        joins.range_join(points, spans, "x", "lo", "hi", 0)


def test_pushdown_and_pruning(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 40").select("l_orderkey")
    assert any("GreaterThan(l_quantity,40.0)" in f for f in report.pushed_filters(df))
    assert report.read_schemas(df)[0] == "struct<l_orderkey:bigint,l_quantity:double>"


def test_reports(spark):
    slow = F.udf(lambda x: x, "long")
    df = spark.range(10).select(slow("id").alias("x")).groupBy("x").count()
    df.collect()
    found = report.summary(df)
    assert ("BatchEvalPython", "row-at-a-time Python") in found["reasons"] and found["native_fraction"] < 1 and found["exchanges"] == 1
    assert report.dot(df).startswith("digraph")
    fine = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()
    assert report.summary(fine)["native_fraction"] == 1


def test_settings(spark):
    assert config.get(spark, "join.capFactor") == 32
    spark.conf.set("sparkloom.join.capFactor", "x")
    with pytest.raises(ValueError):
        config.get(spark, "join.capFactor")
    spark.conf.unset("sparkloom.join.capFactor")


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "ü")], "i int, s string")
    tables.write(df, kind, str(tmp_path / kind))
    assert rows(tables.read(spark, kind, str(tmp_path / kind), df.schema)) == rows(df)


def test_text_and_schema_refusal(spark, tmp_path):
    tables.write(spark.createDataFrame([("x",), ("y",)], "value string"), "text", str(tmp_path / "t"))
    assert rows(tables.read(spark, "text", str(tmp_path / "t"))) == [("x",), ("y",)]
    with pytest.raises(ValueError):
        tables.read(spark, "csv", "nowhere")


def test_bucketed_join_needs_no_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left_b", "right_b"):
            tables.write_bucketed(spark.range(100).withColumnRenamed("id", "k"), name, 4, "k")
        df = spark.table("left_b").join(spark.table("right_b"), "k")
        assert df.count() == 100
        df = spark.table("left_b").join(spark.table("right_b"), "k")
        df.collect()
        assert report.operators(df)["Exchange"] == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists left_b")
        spark.sql("drop table if exists right_b")


@pytest.mark.parametrize("sql, error", [("select 1 / 0", "DIVIDE_BY_ZERO"), ("select cast('x' as int)", "CAST_INVALID_INPUT"), ("select 9223372036854775807 + 1L", "ARITHMETIC_OVERFLOW"), ("select split_part('a,b', ',', 0)", "INVALID_INDEX_OF_ZERO"), ("select sum(v) from values (9223372036854775807L), (1L) t(v)", "ARITHMETIC_OVERFLOW"), ("select -cast(-2147483648 as int)", "ARITHMETIC_OVERFLOW")])
def test_ansi_errors(spark, sql, error):
    with pytest.raises(Exception, match=error):
        spark.sql(sql).collect()


@pytest.mark.parametrize(
    "sql, want",
    [
        ("select double('NaN') = double('NaN')", True),
        ("select double('NaN') > double('Infinity')", True),
        ("select -0.0D = 0.0D", True),
        ("select null and false", False),
        ("select null or true", True),
        ("select null <=> null", True),
        ("select cast(sum(v) as string) from values (cast(99999999999999999999999999999999999999 as decimal(38,0))) t(v)", "99999999999999999999999999999999999999"),
        ("select round(2.5D) + bround(2.5D, 0)", 5.0),
        ("select typeof(avg(v)) from values (cast(1 as decimal(10,2))) t(v)", "decimal(14,6)"),
        ("select typeof(sum(v)) from values (cast(1 as decimal(10,2))) t(v)", "decimal(20,2)"),
        ("select ln(0)", None),
        ("select size(cast(null as array<int>))", None),
        ("select chr(-1)", ""),
        ("select bit_count(-1)", 64),
    ],
)
def test_semantics(spark, sql, want):
    assert spark.sql(sql).first()[0] == want


def test_sample_is_repeatable(spark):
    df = spark.range(10000).repartition(4, "id")
    assert rows(df.sample(False, 0.1, 7)) == rows(df.sample(False, 0.1, 7))


def test_runtime_bloom_filter(spark):
    for k, v in {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        spark.conf.set(k, v)
    try:
        o = tables.table(spark, SF, "orders")
        c = tables.table(spark, SF, "customer").where("c_mktsegment = 'BUILDING'")
        df = o.join(c, o["o_custkey"] == c["c_custkey"])
        df.count()
        assert any("might_contain" in n.text for n in report.tree(df).walk())
    finally:
        spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hash_functions(spark):
    import hashlib
    import zlib

    import xxhash

    words = ["", "a", "Spark", "ünï", "x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "s string").select("s", F.xxhash64("s").alias("x"), F.crc32(F.col("s").cast("binary")).alias("c"), F.md5("s").alias("m"), F.sha2("s", 0).alias("h"))
    for r in df.collect():
        b = r["s"].encode()
        signed = xxhash.xxh64_intdigest(b, 42)
        assert r["x"] == (signed - (1 << 64) if signed >> 63 else signed)
        assert r["c"] == zlib.crc32(b) and r["m"] == hashlib.md5(b).hexdigest() and r["h"] == hashlib.sha256(b).hexdigest()


NODES = {"hash": "ShuffledHashJoin", "merge": "SortMergeJoin", "broadcast": "BroadcastHashJoin"}


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti", "existence"])
@pytest.mark.parametrize("strategy", list(NODES))
def test_every_join_type_under_each_strategy(spark, how, strategy):
    """Rows equal a nested loop's, null keys and a residual included, and the plan has the strategy's operator."""
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5), (None, 7), (4, 1)], "k int, v int")
    right = spark.createDataFrame([(1, 15), (1, 99), (2, 6), (None, 8), (5, 3)], "j int, w int")
    data, other = [tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()]
    match = lambda a, b: a[0] is not None and a[0] == b[0] and b[1] > a[1]
    pairs = [(*a, *b) for a in data for b in other if match(a, b)]
    lone = [(*a, None, None) for a in data if not any(match(a, b) for b in other)]
    far = [(None, None, *b) for b in other if not any(match(a, b) for a in data)]
    want = {"inner": pairs, "left": pairs + lone, "right": pairs + far, "full": pairs + lone + far, "semi": [a for a in data if any(match(a, b) for b in other)], "anti": [a[:2] for a in lone], "existence": [(*a, any(match(a, b) for b in other)) for a in data]}
    if (how, strategy) == ("full", "broadcast"):
        with pytest.raises(ValueError):
            joins.join(left, right, left["k"] == right["j"], how, strategy)
        return
    if how == "existence":
        df = joins.with_existence(left, right, "k", "j", "e", strategy, F.col("w") > F.col("v"))
    else:
        df = joins.join(left, right, (left["k"] == right["j"]) & (F.col("w") > F.col("v")), how, strategy)
    assert rows(df) == sorted(want[how], key=str)
    df.collect()
    assert report.operators(df)[NODES[strategy]] == 1 + (how == "existence")


def test_strategies_on_tables_are_in_the_plans(spark):
    from sparkloom.plans import catalog

    for how in ("left", "right", "semi", "anti"):
        for strategy, node in NODES.items():
            df = catalog.queries()[f"join_{how}_{strategy}"](spark, SF)
            df.collect()
            assert report.operators(df)[node] == 1, (how, strategy)


def test_a_large_build_side_is_not_broadcast(spark):
    """Beyond broadcast.maxBytes the same rows come by merging; within it, by broadcast."""
    from sparkloom.plans import catalog

    for how in ("inner", "left", "right", "semi", "anti", "existence"):
        small = catalog.queries()[f"join_{how}_broadcast"](spark, SF)
        want = rows(small)
        assert report.operators(small)["BroadcastHashJoin"] == 1 + (how == "existence")
        spark.conf.set("sparkloom.broadcast.maxBytes", "1000")
        try:
            df = catalog.queries()[f"join_{how}_broadcast"](spark, SF)
            assert rows(df) == want
        finally:
            spark.conf.unset("sparkloom.broadcast.maxBytes")
        found = report.operators(df)
        assert (found["BroadcastHashJoin"], found["SortMergeJoin"]) == (0, 1 + (how == "existence")), how


def test_built_bytes_counts_rows_and_texts(spark, tmp_path):
    """By what the rows hold, not by their files: one value 100,000 times packs to almost nothing."""
    spark.range(100_000).selectExpr("cast(1 as bigint) as k", "repeat('x', 100) as s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert joins.broadcast_if_small(df, 1_000_000) is not df  # by the optimizer's figure
    assert 100_000 * (100 + 16) <= joins.built_bytes(df) <= 100_000 * (100 + 64)
    assert joins.built_bytes(df.limit(0)) == 0
    odd = spark.createDataFrame([(1, None, [1, 2]), (2, "ab", None)], "`a.b` int, s string, l array<int>")
    assert joins.built_bytes(odd.crossJoin(odd)) > joins.built_bytes(odd) > 2 * (joins.ENTRY + 8 + 24)


def test_percentiles_and_modes(spark):
    import numpy as np

    data = [("a", float(v)) for v in (5, 1, 4, 4, 2)] + [("b", 7.0), ("b", None), (None, 1.0), (None, 3.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: (r["p"], r["m"]) for r in aggregates.percentiles(df, ["k"], "v", p=0.3, m=0.5).collect()}
    for k in ("a", "b", None):
        v = [x for g, x in data if g == k and x is not None]
        assert got[k] == pytest.approx((np.percentile(v, 30), np.median(v)))
    assert got["c"] == (None, None)
    assert dict(rows(aggregates.modes(df, ["k"], "v"))) == {"a": 4.0, "b": 7.0, None: 3.0}
    with pytest.raises(ValueError):
        aggregates.percentiles(df, ["k"], "v", p=1.5)


def test_with_totals_equals_a_window(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), (None, 2), (None, 9), ("b", None)], "k string, v int")
    got = aggregates.with_totals(df, ["k"], hi=F.max("v"), n=F.count("v"))
    assert rows(got) == rows(df.selectExpr("*", "max(v) over (partition by k) as hi", "count(v) over (partition by k) as n"))


def test_rollup_chain_scans_once_and_can_be_off(spark):
    df = aggregates.rollup_chain(tables.table(spark, SF, "lineitem"), ["l_returnflag", "l_linestatus"], n=("count", "l_orderkey"))
    want = rows(df)
    df.collect()
    found = report.operators(df)
    scans = [n for n in report.tree(df).walk() if n.name.startswith("Scan")]
    reused = [n for n in report.tree(df).walk() if n.name.startswith("ReusedExchange")]
    assert len(scans) - len(reused) <= 1 and found["Exchange"] >= 1
    spark.conf.set("sparkloom.rollup.chain", "false")
    try:
        plain = aggregates.rollup_chain(tables.table(spark, SF, "lineitem"), ["l_returnflag", "l_linestatus"], n=("count", "l_orderkey"))
        assert rows(plain) == want and report.operators(plain)["Expand"] == 1
    finally:
        spark.conf.unset("sparkloom.rollup.chain")


def test_range_join_of_wide_intervals(spark):
    """Intervals from nothing to a million buckets: none becomes more than a few rows, and the result is a nested loop's."""
    points = spark.range(300).select((F.col("id") * 997.3).alias("x"))
    spans = spark.createDataFrame([(0.0, 1e6), (10.0, 10.5), (-5e8, 5e8), (5000.0, 9000.0), (None, 3.0), (7.0, 7.0), (8.0, 2.0)], "lo double, hi double")
    got = joins.range_join(points, spans.where("lo <= hi"), "x", "lo", "hi", 1.0)
    want = points.join(spans, (F.col("lo") <= F.col("x")) & (F.col("x") < F.col("hi")))
    assert rows(got) == rows(want)
    with pytest.raises(ValueError):
        joins.range_join(points, spans.where("lo <= hi"), "x", "lo", "hi", 1.0, "left")


def test_metrics_and_history(spark):
    history = report.History(2)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert len(history.run("count", df)) == 7
    found = report.metrics(df)
    assert any(m.get("numOutputRows") == 7 for _, m in found) and any(m.get("shuffleBytesWritten", 0) > 0 for _, m in found)
    bad = spark.range(3).select(F.expr("1 / (id - 1)"))
    with pytest.raises(Exception):
        history.run("fails", bad)
    history.run("again", spark.range(5))
    assert [e["name"] for e in history.entries] == ["fails", "again"] and history.entries[0]["error"] and history.slowest(1)[0]["seconds"] >= 0


def test_json_lines_source(spark, tmp_path):
    import json

    import zstandard

    from sparkloom.sources import jsonl_zst

    jsonl_zst.register(spark)
    for k in range(3):
        lines = "\n".join(json.dumps({"id": k * 10 + j, "text": f"ü{j}" if j else None, "other": 1}) for j in range(4)) + "\n\n"
        (tmp_path / f"{k}.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(lines.encode()))
    df = spark.read.format("jsonl_zst").schema("id long, text string, gone double").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    assert rows(df) == sorted([(k * 10 + j, f"ü{j}" if j else None, None) for k in range(3) for j in range(4)], key=str)
    assert df.where("id >= 20").count() == 4
    with pytest.raises(Exception, match="schema"):
        spark.read.format("jsonl_zst").load(str(tmp_path)).count()
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(b"[1]\n"))
    with pytest.raises(Exception, match="no JSON object"):
        df = spark.read.format("jsonl_zst").schema("id long").load(str(tmp_path)).collect()


def test_jdbc_round_trip_and_missing_formats(spark, tmp_path):
    """By the Derby driver that Spark carries; Avro is a package of its own, and says so."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V")).write.jdbc(url, "T", "overwrite", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    df = tables.read_jdbc(spark, url, "T", "K", 0, 100, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("V")).first()[0] == 9900
    assert any("GreaterThanOrEqual(K,90)" in f for f in report.pushed_filters(df.where("K >= 90")))
    with pytest.raises(Exception, match="[Aa]vro"):
        tables.read(spark, "avro", "nowhere")


def test_streams_equal_batches(spark, tmp_path):
    import datetime

    from sparkloom.streaming import windows

    start = datetime.datetime(2024, 1, 1)
    data = [(k, start + datetime.timedelta(minutes=17 * k), f"u{k % 3}") for k in range(60)]
    events = spark.createDataFrame(data, "id long, ts timestamp, u string")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for make in (lambda d, **o: windows.windowed(d, "ts", "1 hour", ["u"], n=F.count("id"), **o), lambda d, **o: windows.sessions(d, "ts", "40 minutes", ["u"], n=F.count("id"), **o)):
        q = make(stream, late="1 day").writeStream.format("memory").queryName("got").outputMode("complete").option("checkpointLocation", str(tmp_path / f"c{id(make)}")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        assert rows(spark.table("got")) == rows(make(events))
    with pytest.raises(ValueError):
        windows.windowed(stream, "ts", "1 hour", ["u"], n=F.count("id"))
    assert windows.once(events.unionByName(events), "ts", ["id"]).count() == 60


def test_entry_lives_without_the_text_operators(tmp_path):
    """A missing package that only they need takes their queries away, and no others."""
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'tpch_q1' in q, any(x.startswith('op') for x in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=120)
    n, *flags = said.stdout.split()
    assert int(n) > 100 and flags == ["True", "False", "False", "True"], said.stderr[-2000:]
