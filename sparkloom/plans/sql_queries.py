"""Queries in SQL over the driver's tables. SAME holds one text for both engines; PAIRS has one for each, where functions
or types are spelled differently. Money is summed as decimals, so that sums are exact in any order."""

from __future__ import annotations

PRICE = "cast(l_extendedprice as decimal(12,2))"
NET = f"{PRICE} * (1 - cast(l_discount as decimal(4,2)))"

SAME: dict[str, str] = {
    "tpch_q1": f"""
        select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(12,2))) as double) as sum_qty,
               cast(sum({PRICE}) as double) as sum_base_price, cast(sum({NET}) as double) as sum_disc_price,
               cast(sum({NET} * (1 + cast(l_tax as decimal(4,2)))) as double) as sum_charge,
               cast(sum(cast(l_quantity as decimal(12,2))) as double) / count(*) as avg_qty,
               cast(sum({PRICE}) as double) / count(*) as avg_price,
               cast(sum(cast(l_discount as decimal(4,2))) as double) / count(*) as avg_disc, count(*) as count_order
        from lineitem where l_shipdate <= timestamp '2000-09-02 00:00:00'
        group by l_returnflag, l_linestatus""",
    "tpch_q3_shaped": f"""
        select l_orderkey, cast(sum({NET}) as double) as revenue, cast(o_orderdate as date) as o_orderdate
        from customer, orders, lineitem
        where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
          and o_orderdate < timestamp '1998-03-15 00:00:00' and l_shipdate > timestamp '1998-03-15 00:00:00'
        group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""",
    "tpch_q4_shaped": """
        select o_orderpriority, count(*) as order_count from orders
        where o_orderdate >= timestamp '1997-07-01 00:00:00' and o_orderdate < timestamp '1997-10-01 00:00:00'
          and exists (select * from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate and l_quantity > 25)
        group by o_orderpriority""",
    "tpch_q5": f"""
        select n_name, cast(sum({NET}) as double) as revenue
        from customer, orders, lineitem, supplier, nation, region
        where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey
          and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'
          and o_orderdate >= timestamp '1996-01-01 00:00:00' and o_orderdate < timestamp '1998-01-01 00:00:00'
        group by n_name""",
    "tpch_q6": f"""
        select cast(sum({PRICE} * cast(l_discount as decimal(4,2))) as double) as revenue from lineitem
        where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1997-01-01 00:00:00'
          and l_discount between 0.05 and 0.07 and l_quantity < 24""",
    "tpch_q7": f"""
        select supp_nation, cust_nation, l_year, cast(sum(volume) as double) as revenue from (
            select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as int) as l_year, {NET} as volume
            from supplier, lineitem, orders, customer, nation n1, nation n2
            where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey
              and c_nationkey = n2.n_nationkey and n1.n_regionkey = 1 and n2.n_regionkey = 2
              and l_shipdate between timestamp '1996-01-01 00:00:00' and timestamp '1997-12-31 00:00:00') shipping
        group by supp_nation, cust_nation, l_year""",
    "tpch_q8": f"""
        select o_year, cast(sum(case when nation = 'NATION_3' then volume else 0 end) as double) / cast(sum(volume) as double) as mkt_share from (
            select cast(extract(year from o_orderdate) as int) as o_year, {NET} as volume, n2.n_name as nation
            from part, supplier, lineitem, orders, customer, nation n1, nation n2, region
            where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey
              and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey
              and p_type = 'ECONOMY') all_nations
        group by o_year""",
    "tpch_q10_shaped": f"""
        select c_custkey, c_name, cast(sum({NET}) as double) as revenue, c_acctbal, n_name
        from customer, orders, lineitem, nation
        where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= timestamp '1996-10-01 00:00:00'
          and o_orderdate < timestamp '1997-01-01 00:00:00' and l_returnflag = 'R' and c_nationkey = n_nationkey
        group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
    "tpch_q13_shaped": """
        select c_count, count(*) as custdist from (
            select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority <> '1-URGENT'
            group by c_custkey) c_orders
        group by c_count""",
    "tpch_q14": f"""
        select 100.0 * cast(sum(case when p_type = 'PROMO' then {NET} else 0 end) as double) / cast(sum({NET}) as double) as promo_revenue
        from lineitem, part where l_partkey = p_partkey and l_shipdate >= timestamp '1996-09-01 00:00:00' and l_shipdate < timestamp '1996-12-01 00:00:00'""",
    "tpch_q15_shaped": f"""
        with revenue as (
            select l_suppkey as supplier_no, sum({NET}) as total_revenue from lineitem
            where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1996-04-01 00:00:00' group by l_suppkey)
        select s_suppkey, s_name, cast(total_revenue as double) as total_revenue from supplier, revenue
        where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue)""",
    "tpch_q17_shaped": f"""
        select cast(sum({PRICE}) as double) / 7.0 as avg_yearly from lineitem, part
        where p_partkey = l_partkey and p_brand = 'Brand#3'
          and l_quantity < (select 0.5 * avg(l2.l_quantity) from lineitem l2 where l2.l_partkey = p_partkey)""",
    "tpch_q18": """
        select c_name, c_custkey, o_orderkey, o_totalprice, cast(sum(cast(l_quantity as decimal(12,2))) as double) as qty
        from customer, orders, lineitem
        where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 220)
          and c_custkey = o_custkey and o_orderkey = l_orderkey
        group by c_name, c_custkey, o_orderkey, o_totalprice""",
    "tpch_q19_shaped": f"""
        select cast(sum({NET}) as double) as revenue from lineitem, part
        where p_partkey = l_partkey and (
            (p_brand = 'Brand#1' and l_quantity between 1 and 11 and p_size between 1 and 15)
            or (p_brand = 'Brand#2' and l_quantity between 10 and 20 and p_size between 1 and 25)
            or (p_brand = 'Brand#3' and l_quantity between 20 and 30 and p_size between 1 and 35))""",
    "tpch_q22_shaped": """
        select c_mktsegment, count(*) as numcust, cast(sum(cast(c_acctbal as decimal(12,2))) as double) as totacctbal from customer
        where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0)
          and not exists (select * from orders where o_custkey = c_custkey and o_totalprice > 100000)
        group by c_mktsegment""",
    "filter_three_valued": """
        select l_orderkey, l_linenumber from (select *, nullif(l_returnflag, 'A') as f, nullif(l_linenumber, 3) as n from lineitem) t
        where (f = 'R' or n > 5) and not (f = 'N' and n = 6)""",
    "filter_null_safe": """
        select o_orderkey from (select o_orderkey, nullif(o_orderstatus, 'P') as a, nullif(o_orderstatus, 'F') as b from orders) t
        where a is not distinct from b or (a is null and b = 'P')""",
    "filter_in_between": "select p_partkey, p_brand from part where p_brand in ('Brand#1', 'Brand#4') and p_size between 5 and 25 and p_type not in ('PROMO')",
    "filter_like": "select p_partkey, p_name from part where p_name like '%1%' and p_name not like '%9' and p_type like 'S%A%' or p_brand like 'Brand#2%'",
    "project_case": """
        select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band,
               coalesce(nullif(o_orderstatus, 'O'), '-') as status, nullif(o_orderpriority, '5-LOW') as priority, cast(null as int) as nothing, 1 as one
        from orders""",
    "union_all": "select n_name as name, n_regionkey as k from nation union all select r_name, r_regionkey from region",
    "union_distinct": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "intersect_distinct": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "intersect_all": "select o_custkey % 50 as k from orders intersect all select c_custkey % 50 from customer",
    "except_distinct": "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 40",
    "top_n": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "top_n_offset": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 15",
    "join_inner_residual": "select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey and l_extendedprice > o_totalprice * 0.3",
    "join_left": "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_totalprice > 150000 group by c_custkey",
    "join_right": "select s_suppkey, n_name from nation right join supplier on n_nationkey = s_nationkey and n_regionkey = 2",
    "join_full": """
        select a.k as ak, b.k as bk, a.n as an, b.n as bn from
            (select nullif(c_nationkey, 7) as k, count(*) as n from customer where c_nationkey < 15 group by 1) a
            full join (select nullif(s_nationkey, 9) as k, count(*) as n from supplier where s_nationkey > 5 group by 1) b on a.k = b.k""",
    "join_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
    "join_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "join_not_in": "select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49 and l_discount > 0.08)",
    "join_not_in_null": "select s_suppkey from supplier where s_suppkey not in (select nullif(l_suppkey, 5) from lineitem where l_linenumber = 1)",
    "join_not_in_empty": "select s_suppkey from supplier where nullif(s_suppkey, 3) not in (select l_suppkey from lineitem where l_quantity > 1000)",
    "join_existence_or": "select c_custkey from customer where c_acctbal < 0 or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "join_theta": "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey >= b.n_regionkey",
    "join_cross": "select r_name, n_name from region cross join nation",
    "scalar_subquery": "select o_orderkey from orders where o_totalprice > (select 2 * avg(o_totalprice) from orders)",
    "distinct_rows": "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem",
    "agg_distinct": "select l_returnflag, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts, count(*) as n from lineitem group by l_returnflag",
    "agg_filter": """
        select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, cast(sum(cast(o_totalprice as decimal(12,2))) filter (where o_orderpriority = '1-URGENT') as double) as urgent,
               min(o_orderdate) filter (where o_totalprice > 200000) as first_big from orders group by o_orderstatus""",
    "agg_empty": "select count(*) as n, max(o_totalprice) as m, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as s from orders where o_orderkey < 0",
    "agg_bool": "select l_returnflag, bool_and(l_quantity > 0) as all_pos, bool_or(l_quantity > 49) as any_big from lineitem group by l_returnflag",
    "agg_bits": "select l_returnflag, bit_and(l_orderkey) as a, bit_or(l_orderkey) as o, bit_xor(l_orderkey) as x from lineitem group by l_returnflag",
    "agg_min_max_strings": "select o_orderstatus, min(o_orderpriority) as lo, max(o_orderpriority) as hi from orders group by o_orderstatus",
    "agg_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12",
    "agg_rollup": "select o_orderstatus, o_orderpriority, cast(grouping(o_orderpriority) as int) as g, count(*) as n from orders group by rollup(o_orderstatus, o_orderpriority)",
    "agg_cube": "select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as m from orders group by cube(o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "select l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linenumber), ())",
    "window_running": """
        select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as n,
               max(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as hi from orders""",
    "window_range_peers": "select p_partkey, count(*) over (partition by p_brand order by p_size) as upto, min(p_retailprice) over (partition by p_brand order by p_size) as lo from part",
    "window_sliding": """
        select o_orderkey, min(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following) as lo,
               count(*) over (partition by o_custkey order by o_orderkey rows between 3 following and 5 following) as n from orders""",
    "window_lag_lead": """
        select o_orderkey, lag(o_totalprice, 1) over w as before, lead(o_totalprice, 2, -1.0) over w as after,
               first_value(o_orderkey) over w as f, last_value(o_orderkey) over w as l, nth_value(o_orderkey, 2) over w as second
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "window_group_limit": """
        select o_custkey, o_orderkey, o_totalprice from (
            select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) t where rn <= 2""",
    "window_rank_limit": """
        select p_brand, p_partkey from (select *, rank() over (partition by p_brand order by p_size desc) as rk from part) t where rk <= 3""",
}

SAME |= {
    "limit_counts": "select count(*) as n from (select o_orderkey from orders limit 37) t",
    "limit_offset_all": "select count(*) as n from (select o_orderkey from orders order by o_orderkey limit 1000000 offset 100) t",
    "agg_ungrouped": "select count(*) as n, count(nullif(o_orderstatus, 'F')) as k, min(o_totalprice) as lo, max(o_totalprice) as hi, min(o_orderdate) as d from orders",
    "agg_expression_keys": "select o_custkey % 10 as k, o_totalprice > 100000 as big, count(*) as n from orders group by o_custkey % 10, o_totalprice > 100000",
    "agg_null_keys": "select nullif(o_orderstatus, 'O') as k, count(*) as n from orders group by nullif(o_orderstatus, 'O')",
    "agg_decimal_keys": "select cast(l_discount as decimal(4,2)) as k, count(*) as n from lineitem group by cast(l_discount as decimal(4,2))",
    "agg_date_keys": "select cast(o_orderdate as date) as k, count(*) as n from orders group by cast(o_orderdate as date)",
    "join_on_expressions": "select count(*) as n, max(o_orderkey) as m from orders join part on o_custkey % 97 = p_size and o_orderkey % 13 = p_partkey % 13",
    "join_two_keys": "select a.l_orderkey, a.l_linenumber from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber + 1 and a.l_extendedprice > b.l_extendedprice",
    "join_string_keys": "select count(*) as n from supplier join nation on concat('NATION_', cast(s_nationkey as varchar(10))) = n_name",
    "join_left_theta": "select r_name, n_name from region left join nation on n_nationkey < r_regionkey * 3 and n_regionkey <> r_regionkey",
    "join_semi_residual": "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_extendedprice > 0.6 * o_totalprice)",
    "join_anti_residual": "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 10)",
    "cte_reused": "with t as (select o_custkey, count(*) as n from orders group by o_custkey) select a.n, count(*) as k from t a join t b on a.o_custkey = b.o_custkey group by a.n",
    "correlated_scalar": "select c_custkey, (select max(o_orderkey) from orders where o_custkey = c_custkey) as m from customer",
    "window_running_avg": "select o_orderkey, sum(cast(o_totalprice as decimal(12,2))) over w as s from orders window w as (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row)",
    "window_null_partition": "select p_partkey, count(*) over (partition by nullif(p_type, 'PROMO') order by p_partkey) as n from part",
}

PAIRS: dict[str, tuple[str, str]] = {
    "window_ignore_nulls": (
        "select o_orderkey, last_value(nullif(o_orderstatus, 'O')) ignore nulls over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as s from orders",
        "select o_orderkey, last_value(nullif(o_orderstatus, 'O') ignore nulls) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as s from orders",
    ),
    "nan_order": (
        "select k, x > 1.0D as gt, x = double('NaN') as eq, x in (double('NaN'), 2.0D) as isin from (select o_orderkey as k, case when o_orderkey % 3 = 0 then double('NaN') when o_orderkey % 3 = 1 then -0.0D else 2.0D end as x from orders) t",
        "select k, x > 1.0 as gt, x = 'NaN'::double as eq, x in ('NaN'::double, 2.0) as isin from (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'NaN'::double when o_orderkey % 3 = 1 then 0.0::double else 2.0::double end as x from orders) t",
    ),
    "decimal_arithmetic": (
        "select l_orderkey, l_linenumber, cast(a + b as decimal(14,4)) as s, cast(a - b as decimal(14,4)) as d, cast(a * b as decimal(18,6)) as m, abs(b - a) > 100 as far, -b as neg from (select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(12,2)) as a, cast(l_tax as decimal(5,4)) as b from lineitem) t",
        "select l_orderkey, l_linenumber, cast(a + b as decimal(14,4)) as s, cast(a - b as decimal(14,4)) as d, cast(a * b as decimal(18,6)) as m, abs(b - a) > 100 as far, -b as neg from (select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(12,2)) as a, cast(l_tax as decimal(5,4)) as b from lineitem) t",
    ),
    "fn_math_more": (
        "select p_partkey, round(expm1(p_size / 50.0D), 9) as a, round(log1p(p_size), 9) as b, round(hypot(p_size, 3), 9) as c, round(acos(1.0D / (1 + p_size)), 9) as d, round(cosh(p_size / 30.0D), 9) as e, round(asinh(p_size), 9) as f, round(acosh(1 + p_size), 9) as g, round(atanh(1.0D / (1 + p_size)), 9) as h, round(sec(p_size / 40.0D), 9) as i, round(csc(p_size), 6) as j, signum(p_size - 20.0D) as k, positive(p_size) as l, negative(p_size) as m, round(log(2, p_size), 9) as n from part",
        "select p_partkey, round(exp(p_size / 50.0::double) - 1, 9) as a, round(ln(1 + p_size), 9) as b, round(sqrt(p_size * p_size + 9), 9) as c, round(acos(1.0::double / (1 + p_size)), 9) as d, round(cosh(p_size / 30.0::double), 9) as e, round(asinh(p_size), 9) as f, round(acosh(1 + p_size), 9) as g, round(atanh(1.0::double / (1 + p_size)), 9) as h, round(1 / cos(p_size / 40.0::double), 9) as i, round(1 / sin(p_size), 6) as j, cast(sign(p_size - 20.0) as double) as k, p_size as l, -p_size as m, round(log(2, p_size), 9) as n from part",
    ),
    "fn_cast_strings": (
        "select event_id, cast(cast(ts as date) as string) as d, cast(value > 50 as string) as b, cast('  42 ' as int) as i, try_cast('x1' as double) as x, cast('true' as boolean) as t, cast(cast(event_id as decimal(12,2)) as string) as s, cast(cast(value as decimal(10,2)) as bigint) as l from events",
        "select event_id, cast(cast(ts as date) as varchar) as d, cast(value > 50 as varchar) as b, 42 as i, try_cast('x1' as double) as x, cast('true' as boolean) as t, cast(cast(event_id as decimal(12,2)) as varchar) as s, cast(trunc(cast(value as decimal(10,2))) as bigint) as l from events",
    ),
    "fn_time_units": (
        "select event_id, cast(timestamp_millis(event_id * 1000) as timestamp_ntz) as a, cast(timestamp_micros(event_id) as timestamp_ntz) as b, unix_millis(cast(date_trunc('SECOND', ts) as timestamp)) as c, unix_seconds(cast(ts as timestamp)) as d, from_unixtime(event_id, 'yyyy-MM-dd HH:mm:ss') as e, cast(cast(cast(ts as date) as timestamp) as timestamp_ntz) as f from events",
        "select event_id, cast(make_timestamp(event_id * 1000000) as timestamp) as a, cast(make_timestamp(event_id) as timestamp) as b, cast(epoch_ms(date_trunc('second', ts)) as bigint) as c, cast(floor(epoch(ts)) as bigint) as d, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') as e, cast(cast(ts as date) as timestamp) as f from events",
    ),
    "agg_statistics": (
        """select p_brand, count(*) as n, round(stddev_samp(p_size), 6) as sd, round(var_pop(p_size), 6) as vp, round(skewness(p_size), 6) as sk, round(kurtosis(p_size), 6) as ku from part group by p_brand""",
        """select p_brand, count(*) as n, round(stddev_samp(p_size), 6) as sd, round(var_pop(p_size), 6) as vp,
                  round((avg(p_size * p_size * p_size) - 3 * avg(p_size) * avg(p_size * p_size) + 2 * avg(p_size) ** 3) / var_pop(p_size) ** 1.5, 6) as sk,
                  round(kurtosis_pop(p_size), 6) as ku from part group by p_brand""",
    ),
    "agg_regression": (
        "select p_brand, round(corr(p_retailprice, p_size), 6) as r, round(covar_samp(p_retailprice, p_size), 4) as cs, round(covar_pop(p_retailprice, p_size), 4) as cp, regr_count(p_retailprice, p_size) as n, round(regr_slope(p_retailprice, p_size), 5) as b, round(regr_intercept(p_retailprice, p_size), 4) as a, round(regr_r2(p_retailprice, p_size), 6) as r2, round(regr_avgx(p_retailprice, p_size), 6) as ax, round(regr_sxx(p_retailprice, p_size), 4) as sxx from part group by p_brand",
        "select p_brand, round(corr(p_retailprice, p_size), 6) as r, round(covar_samp(p_retailprice, p_size), 4) as cs, round(covar_pop(p_retailprice, p_size), 4) as cp, cast(regr_count(p_retailprice, p_size) as bigint) as n, round(regr_slope(p_retailprice, p_size), 5) as b, round(regr_intercept(p_retailprice, p_size), 4) as a, round(regr_r2(p_retailprice, p_size), 6) as r2, round(regr_avgx(p_retailprice, p_size), 6) as ax, round(regr_sxx(p_retailprice, p_size), 4) as sxx from part group by p_brand",
    ),
    "agg_sum_ints": (
        "select l_returnflag, sum(l_linenumber) as s, try_sum(l_orderkey) as t, count_if(l_quantity > 25) as n, round(try_avg(l_linenumber), 9) as a from lineitem group by l_returnflag",
        "select l_returnflag, cast(sum(l_linenumber) as bigint) as s, cast(sum(l_orderkey) as bigint) as t, cast(count_if(l_quantity > 25) as bigint) as n, round(avg(l_linenumber), 9) as a from lineitem group by l_returnflag",
    ),
    "agg_max_by": (
        "select o_orderstatus, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) as top, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) as low from orders group by o_orderstatus",
        "select o_orderstatus, max_by(o_orderkey, (o_totalprice, o_orderkey)) as top, min_by(o_orderkey, (o_totalprice, o_orderkey)) as low from orders group by o_orderstatus",
    ),
    "agg_collect": (
        "select o_orderstatus, array_join(sort_array(collect_set(o_orderpriority)), ',') as ps, size(collect_list(o_orderkey)) as n from orders group by o_orderstatus",
        "select o_orderstatus, array_to_string(list_sort(list(distinct o_orderpriority)), ',') as ps, cast(len(list(o_orderkey)) as int) as n from orders group by o_orderstatus",
    ),
    "agg_decimal": (
        "select l_linestatus, cast(sum(cast(l_extendedprice as decimal(20,4))) as decimal(30,4)) as s, cast(avg(cast(l_extendedprice as decimal(12,2))) as decimal(16,6)) as a, max(cast(l_tax as decimal(5,3))) as m from lineitem group by l_linestatus",
        "select l_linestatus, cast(sum(cast(l_extendedprice as decimal(20,4))) as decimal(30,4)) as s, cast(cast(sum(cast(l_extendedprice as decimal(12,2))) as decimal(38,8)) / count(*) as decimal(16,6)) as a, max(cast(l_tax as decimal(5,3))) as m from lineitem group by l_linestatus",
    ),
    "window_ranks": (
        "select p_partkey, row_number() over w as rn, rank() over (partition by p_brand order by p_size) as rk, dense_rank() over (partition by p_brand order by p_size) as dr, round(percent_rank() over (partition by p_brand order by p_size), 9) as pr, round(cume_dist() over (partition by p_brand order by p_size), 9) as cd, ntile(7) over w as nt from part window w as (partition by p_brand order by p_size, p_partkey)",
        "select p_partkey, cast(row_number() over w as int) as rn, cast(rank() over (partition by p_brand order by p_size) as int) as rk, cast(dense_rank() over (partition by p_brand order by p_size) as int) as dr, round(percent_rank() over (partition by p_brand order by p_size), 9) as pr, round(cume_dist() over (partition by p_brand order by p_size), 9) as cd, cast(ntile(7) over w as int) as nt from part window w as (partition by p_brand order by p_size, p_partkey)",
    ),
    "window_range_offset": (
        "select p_partkey, count(*) over (partition by p_brand order by p_size range between 3 preceding and 2 following) as n from part",
        "select p_partkey, count(*) over (partition by p_brand order by p_size range between 3 preceding and 2 following) as n from part",
    ),
    "fn_strings_find": (
        "select p_partkey, instr(p_name, 'a') as i, locate('a', p_name, 3) as l, position('r' in p_name) as p, find_in_set(p_type, 'PROMO,SMALL,LARGE') as f, startswith(p_name, 'p') as sw, endswith(p_name, '1') as ew, contains(p_name, '2') as co from part",
        "select p_partkey, cast(instr(p_name, 'a') as int) as i, cast(case when instr(substr(p_name, 3), 'a') = 0 then 0 else instr(substr(p_name, 3), 'a') + 2 end as int) as l, cast(position('r' in p_name) as int) as p, cast(coalesce(list_position(['PROMO','SMALL','LARGE'], p_type), 0) as int) as f, starts_with(p_name, 'p') as sw, ends_with(p_name, '1') as ew, contains(p_name, '2') as co from part",
    ),
    "fn_strings_cut": (
        "select p_partkey, substring(p_name, 2, 3) as a, substring(p_name, -3, 2) as b, left(p_name, 4) as c, right(p_name, 3) as d, split_part(p_brand, '#', 2) as e, substring_index(p_brand, '#', 1) as f, trim(concat('  ', p_type, ' ')) as g, ltrim('BP', p_brand) as h, rtrim(concat(p_type, '   ')) as i from part",
        "select p_partkey, substring(p_name, 2, 3) as a, substring(p_name, -3, 2) as b, left(p_name, 4) as c, right(p_name, 3) as d, split_part(p_brand, '#', 2) as e, split_part(p_brand, '#', 1) as f, trim(concat('  ', p_type, ' ')) as g, ltrim(p_brand, 'BP') as h, rtrim(concat(p_type, '   ')) as i from part",
    ),
    "fn_strings_change": (
        "select p_partkey, upper(p_name) as u, lower(p_type) as l, initcap(lower(p_type)) as ic, replace(p_name, 'a', 'xy') as r, translate(p_type, 'AEM', 'aeX') as t, lpad(p_brand, 10, '*') as lp, rpad(p_type, 3, '-') as rp, repeat('ab', p_size % 3) as re, reverse(p_type) as rv, concat_ws('-', p_brand, nullif(p_type, 'PROMO')) as cw, overlay(p_brand placing 'zz' from 2 for 3) as ov from part",
        "select p_partkey, upper(p_name) as u, lower(p_type) as l, upper(left(p_type, 1)) || lower(substr(p_type, 2)) as ic, replace(p_name, 'a', 'xy') as r, translate(p_type, 'AEM', 'aeX') as t, lpad(p_brand, 10, '*') as lp, rpad(p_type, 3, '-') as rp, repeat('ab', p_size % 3) as re, reverse(p_type) as rv, concat_ws('-', p_brand, nullif(p_type, 'PROMO')) as cw, left(p_brand, 1) || 'zz' || substr(p_brand, 5) as ov from part",
    ),
    "fn_strings_size": (
        "select doc_id, length(text) as n, octet_length(text) as b, bit_length(text) as bits, if(text = '', -1, ascii(text)) as a, chr(65 + cast(doc_id % 26 as int)) as c, elt(if(doc_id % 2 = 0, 1, 2), lang, source) as e from documents",
        "select doc_id, cast(length(text) as int) as n, cast(octet_length(encode(text)) as int) as b, cast(8 * octet_length(encode(text)) as int) as bits, cast(unicode(text) as int) as a, chr(65 + cast(doc_id % 26 as int)) as c, case when doc_id % 2 = 0 then lang else source end as e from documents",
    ),
    "fn_hashes": (
        "select c_custkey, md5(c_name) as m, sha1(c_name) as s1, sha2(c_name, 256) as s2, lower(hex(c_name)) as h from customer",
        "select c_custkey, md5(c_name) as m, sha1(c_name) as s1, sha256(c_name) as s2, lower(hex(c_name)) as h from customer",
    ),
    "fn_arithmetic": (
        "select l_orderkey, l_linenumber, l_orderkey % 7 as m, pmod(-l_orderkey, 7) as pm, l_orderkey div 3 as d, try_divide(l_linenumber, l_linenumber - 3) as td, try_add(l_linenumber, 1) as ta, -l_linenumber as neg, abs(l_linenumber - 4) as ab, sign(l_linenumber - 4.0D) as sg, greatest(l_linenumber, nullif(3, l_linenumber)) as g, least(l_linenumber, 3) as le from lineitem",
        "select l_orderkey, l_linenumber, l_orderkey % 7 as m, ((-l_orderkey % 7) + 7) % 7 as pm, l_orderkey // 3 as d, case when l_linenumber = 3 then null else l_linenumber / (l_linenumber - 3) end as td, l_linenumber + 1 as ta, -l_linenumber as neg, abs(l_linenumber - 4) as ab, cast(sign(l_linenumber - 4.0) as double) as sg, greatest(l_linenumber, nullif(3, l_linenumber)) as g, least(l_linenumber, 3) as le from lineitem",
    ),
    "fn_math": (
        "select p_partkey, round(sqrt(p_size), 9) as a, round(cbrt(p_size), 9) as b, round(exp(p_size / 10.0D), 6) as c, round(ln(p_size), 9) as d, round(log2(p_size), 9) as e, round(log10(p_size), 9) as f, round(pow(p_size, 1.5D), 6) as g, round(sin(p_size), 9) as h, round(cos(p_size), 9) as i, round(tan(p_size), 6) as j, round(atan2(p_size, 3), 9) as k, round(degrees(p_size), 6) as l, round(radians(p_size), 9) as m, round(sinh(p_size / 20.0D), 9) as n, round(atan(p_size), 9) as o, round(asin(1.0D / p_size), 9) as q, round(cot(p_size), 6) as r, round(tanh(p_size / 20.0D), 9) as s from part",
        "select p_partkey, round(sqrt(p_size), 9) as a, round(cbrt(p_size), 9) as b, round(exp(p_size / 10.0::double), 6) as c, round(ln(p_size), 9) as d, round(log2(p_size), 9) as e, round(log10(p_size), 9) as f, round(pow(p_size, 1.5::double), 6) as g, round(sin(p_size), 9) as h, round(cos(p_size), 9) as i, round(tan(p_size), 6) as j, round(atan2(p_size, 3), 9) as k, round(degrees(p_size), 6) as l, round(radians(p_size), 9) as m, round(sinh(p_size / 20.0::double), 9) as n, round(atan(p_size), 9) as o, round(asin(1.0::double / p_size), 9) as q, round(cot(p_size), 6) as r, round(tanh(p_size / 20.0::double), 9) as s from part",
    ),
    "fn_rounding": (
        "select l_orderkey, l_linenumber, ceil(l_extendedprice) as c, floor(l_extendedprice) as f, rint(l_quantity / 4) as r, cast(round(cast(l_extendedprice as decimal(12,2)), 1) as decimal(12,1)) as d, cast(bround(l_quantity / 4, 0) as double) as b from lineitem",
        "select l_orderkey, l_linenumber, cast(ceil(l_extendedprice) as bigint) as c, cast(floor(l_extendedprice) as bigint) as f, round_even(l_quantity / 4, 0) as r, cast(round(cast(l_extendedprice as decimal(12,2)), 1) as decimal(12,1)) as d, round_even(l_quantity / 4, 0) as b from lineitem",
    ),
    "fn_bits": (
        "select o_orderkey, o_orderkey & 255 as a, o_orderkey | 3 as o, o_orderkey ^ 77 as x, ~o_orderkey as n, shiftleft(o_orderkey, 3) as sl, shiftright(o_orderkey, 2) as sr, bit_count(o_orderkey) as bc, getbit(o_orderkey, 0) as b0 from orders",
        "select o_orderkey, o_orderkey & 255 as a, o_orderkey | 3 as o, xor(o_orderkey, 77::bigint) as x, ~o_orderkey as n, o_orderkey << 3 as sl, o_orderkey >> 2 as sr, cast(bit_count(o_orderkey) as int) as bc, cast(o_orderkey & 1 as tinyint) as b0 from orders",
    ),
    "fn_casts": (
        "select o_orderkey, cast(o_totalprice as int) as i, cast(o_orderkey as string) as s, cast(cast(o_orderkey as string) as bigint) as l, cast(o_orderkey % 2 as boolean) as b, cast(cast(o_totalprice as decimal(12,2)) as decimal(12,1)) as d, try_cast(o_orderpriority as int) as t, cast(o_orderdate as date) as dt, cast('2020-02-29' as date) as lit, cast(o_orderkey as double) as f from orders",
        "select o_orderkey, cast(trunc(o_totalprice) as int) as i, cast(o_orderkey as varchar) as s, cast(cast(o_orderkey as varchar) as bigint) as l, cast(o_orderkey % 2 as boolean) as b, cast(cast(o_totalprice as decimal(12,2)) as decimal(12,1)) as d, try_cast(o_orderpriority as int) as t, cast(o_orderdate as date) as dt, cast('2020-02-29' as date) as lit, cast(o_orderkey as double) as f from orders",
    ),
    "fn_conditional": (
        "select o_orderkey, if(o_totalprice > 100000, 'a', 'b') as i, nvl(nullif(o_orderstatus, 'F'), 'none') as n, nvl2(nullif(o_orderstatus, 'F'), 1, 0) as n2, ifnull(nullif(o_orderpriority, '1-URGENT'), 'x') as f, nanvl(if(o_orderkey % 5 = 0, double('NaN'), 1.0D), 7.0D) as nv, isnan(if(o_orderkey % 5 = 0, double('NaN'), 1.0D)) as nn from orders",
        "select o_orderkey, case when o_totalprice > 100000 then 'a' else 'b' end as i, coalesce(nullif(o_orderstatus, 'F'), 'none') as n, case when nullif(o_orderstatus, 'F') is not null then 1 else 0 end as n2, ifnull(nullif(o_orderpriority, '1-URGENT'), 'x') as f, case when o_orderkey % 5 = 0 then 7.0::double else 1.0::double end as nv, o_orderkey % 5 = 0 as nn from orders",
    ),
    "fn_dates": (
        "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, quarter(o_orderdate) as q, dayofweek(o_orderdate) as dw, weekday(o_orderdate) as wd, dayofyear(o_orderdate) as dy, weekofyear(o_orderdate) as w, last_day(o_orderdate) as ld, date_add(cast(o_orderdate as date), 10) as da, date_sub(cast(o_orderdate as date), 3) as ds, datediff(cast(o_orderdate as date), date '1996-01-01') as dd, add_months(cast(o_orderdate as date), 1) as am, trunc(cast(o_orderdate as date), 'MONTH') as tm, trunc(cast(o_orderdate as date), 'WEEK') as tw, make_date(2020, month(o_orderdate), 1) as md from orders",
        "select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(day(o_orderdate) as int) as d, cast(quarter(o_orderdate) as int) as q, cast(dayofweek(o_orderdate) + 1 as int) as dw, cast(isodow(o_orderdate) - 1 as int) as wd, cast(dayofyear(o_orderdate) as int) as dy, cast(weekofyear(o_orderdate) as int) as w, last_day(o_orderdate) as ld, cast(cast(o_orderdate as date) + 10 as date) as da, cast(cast(o_orderdate as date) - 3 as date) as ds, cast(datediff('day', date '1996-01-01', cast(o_orderdate as date)) as int) as dd, cast(cast(o_orderdate as date) + interval 1 month as date) as am, cast(date_trunc('month', o_orderdate) as date) as tm, cast(date_trunc('week', o_orderdate) as date) as tw, make_date(2020, month(o_orderdate), 1) as md from orders",
    ),
    "fn_times": (
        "select event_id, hour(ts) as h, minute(ts) as m, cast(second(ts) as int) as s, cast(date_trunc('HOUR', ts) as timestamp_ntz) as th, cast(date_trunc('WEEK', ts) as timestamp_ntz) as tw, unix_timestamp(cast(ts as timestamp)) as u, unix_date(cast(ts as date)) as ud, date_from_unix_date(19723 + cast(event_id % 30 as int)) as dud, date_format(ts, 'yyyy-MM-dd HH:mm') as f, cast(timestamp_seconds(1700000000 + event_id) as timestamp_ntz) as fs from events",
        "select event_id, cast(hour(ts) as int) as h, cast(minute(ts) as int) as m, cast(second(ts) as int) as s, date_trunc('hour', ts) as th, cast(date_trunc('week', ts) as timestamp) as tw, cast(floor(epoch(ts)) as bigint) as u, cast(datediff('day', date '1970-01-01', cast(ts as date)) as int) as ud, cast(date '1970-01-01' + cast(19723 + event_id % 30 as int) as date) as dud, strftime(ts, '%Y-%m-%d %H:%M') as f, cast(make_timestamp((1700000000 + event_id) * 1000000) as timestamp) as fs from events",
    ),
    "fn_arrays": (
        "select vec_id, size(embedding) as n, cast(element_at(embedding, 1) as double) as first, cast(array_max(embedding) as double) as hi, exists(embedding, x -> x > 0.3) as some, size(filter(embedding, x -> x > 0)) as pos from embeddings",
        "select vec_id, cast(len(embedding) as int) as n, cast(embedding[1] as double) as first, cast(list_max(embedding) as double) as hi, list_bool_or([x > 0.3 for x in embedding]) as some, cast(len([x for x in embedding if x > 0]) as int) as pos from embeddings",
    ),
    "fn_json": (
        "select event_id, cast(get_json_object(props, '$.k') as int) as k, from_json(props, 'k int').k as k2 from events",
        "select event_id, cast(json_extract_string(props, '$.k') as int) as k, cast(json_extract_string(props, '$.k') as int) as k2 from events",
    ),
    "fn_regex": (
        "select p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) as n, regexp_replace(p_name, '[aeiou]', '_') as r, p_name rlike '^[a-m]' as m from part",
        "select p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) as n, regexp_replace(p_name, '[aeiou]', '_', 'g') as r, regexp_matches(p_name, '^[a-m]') as m from part",
    ),
    "generate_outer": (
        "select n_nationkey, x from nation lateral view outer explode(if(n_regionkey = 2, array(), if(n_regionkey = 3, null, array(n_regionkey, null)))) t as x",
        "select n_nationkey, case when n_regionkey in (2, 3) then null when i = 1 then n_regionkey end as x from nation, range(1, 3) r(i) where i = 1 or n_regionkey not in (2, 3)",
    ),
    "structs_maps": (
        "select c_custkey, s.a.b as b, m['seg'] as seg, size(m) as n from (select c_custkey, struct(struct(c_name as b) as a) as s, map('seg', c_mktsegment, 'x', 'y') as m from customer) t",
        "select c_custkey, c_name as b, c_mktsegment as seg, 2 as n from customer",
    ),
    "pivot": (
        "select * from (select l_returnflag, l_linestatus, l_linenumber from lineitem) pivot (count(l_linenumber) for l_linestatus in ('O' as o, 'F' as f))",
        "select l_returnflag, nullif(count(*) filter (where l_linestatus = 'O'), 0) as o, nullif(count(*) filter (where l_linestatus = 'F'), 0) as f from lineitem group by 1",
    ),
    "try_arithmetic": (
        "select o_orderkey, try_multiply(o_orderkey, 9223372036854775807) as m, try_subtract(o_orderkey, 1) as s, try_mod(o_orderkey, o_orderkey % 3) as r from orders where o_orderkey > 1",
        "select o_orderkey, cast(null as bigint) as m, o_orderkey - 1 as s, case when o_orderkey % 3 = 0 then null else o_orderkey % (o_orderkey % 3) end as r from orders where o_orderkey > 1",
    ),
}

SAME |= {
    "except_all": "select l_linenumber as k from lineitem except all select l_linenumber from lineitem where l_returnflag = 'R'",
    "sort_nulls": "select k, n from (select nullif(o_orderpriority, '3-MEDIUM') as k, count(*) as n from orders group by 1) t order by k desc nulls last, n",
    "join_null_keys": "select count(*) as n from (select nullif(o_orderstatus, 'F') as k from orders) a join (select distinct nullif(l_linestatus, 'F') as k from lineitem) b on a.k = b.k",
    "join_null_safe_keys": "select a.k, count(*) as n from (select nullif(o_orderstatus, 'F') as k from orders) a join (select distinct nullif(l_linestatus, 'F') as k from lineitem) b on a.k is not distinct from b.k group by a.k",
}
PAIRS |= {
    # All rows of a customer lie in one partition, in order: the aggregate needs no exchange of its own.
    "agg_first_last": (
        "select o_custkey, first(o_orderkey, true) as f, last(o_orderkey) as l from (select * from orders distribute by o_custkey sort by o_custkey, o_orderkey) t group by o_custkey",
        "select o_custkey, min(o_orderkey) as f, max(o_orderkey) as l from orders group by o_custkey",
    ),
    "sort_by": ("select o_orderkey, o_totalprice from orders sort by o_totalprice desc", "select o_orderkey, o_totalprice from orders"),
    # The last days of both months are whole months apart.
    "fn_months": (
        "select o_orderkey, round(months_between(o_orderdate, timestamp '1996-01-31 00:00:00'), 6) as mb, next_day(cast(o_orderdate as date), 'MO') as nd from orders",
        "select o_orderkey, round((year(o_orderdate) - 1996) * 12 + month(o_orderdate) - 1 + case when cast(o_orderdate as date) = last_day(o_orderdate) then 0 else (day(o_orderdate) - 31) / 31.0 + epoch(o_orderdate - date_trunc('day', o_orderdate)) / 86400.0 / 31.0 end, 6) as mb, cast(cast(o_orderdate as date) + cast(8 - isodow(o_orderdate) as int) as date) as nd from orders",
    ),
    "generate_explode": (
        "select vec_id, label, pos, cast(x as double) as x from embeddings lateral view posexplode(embedding) t as pos, x",
        "select vec_id, label, cast(i - 1 as int) as pos, cast(embedding[i] as double) as x from (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) t",
    ),
}

#: Doubles as they are. Sums are of cents, so rounding to cents hides only the order of additions.
SAME |= {
    "agg_double_sum": "select l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) as s, round(avg(l_discount), 9) as a, min(l_tax) as lo, max(l_extendedprice) as hi, count(l_quantity) as n from lineitem group by l_returnflag, l_linestatus",
    "tpch_q1_doubles": """
        select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price,
               round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
        from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus""",
    "tpch_q6_doubles": """
        select round(sum(l_extendedprice * l_discount), 4) as revenue from lineitem
        where l_shipdate >= timestamp '1994-01-01 00:00:00' and l_shipdate < timestamp '1995-01-01 00:00:00' and l_discount between 0.05 and 0.07 and l_quantity < 24""",
    "agg_double_ungrouped": "select round(sum(o_totalprice), 2) as s, round(avg(o_totalprice), 6) as a from orders",
    "agg_single_rows": "select p_partkey, stddev_samp(p_size) as ss, var_samp(p_size) as vs, stddev_pop(p_size) as sp, var_pop(p_size) as vp, round(avg(p_retailprice), 2) as a from part group by p_partkey",
    "agg_constant_groups": "select p_size, stddev_samp(p_size) as ss, var_samp(p_size) as vs, stddev_pop(p_size) as sp, round(stddev_pop(p_retailprice), 6) as rp, round(var_samp(p_retailprice), 4) as rv from part group by p_size",
    "filter_booleans": "select o_orderkey, (o_totalprice > 150000) = (o_orderstatus = 'F') as eq, (o_totalprice > 150000) < (o_orderstatus = 'F') as lt, (o_totalprice > 150000) >= (o_orderstatus = 'F') as ge, (o_totalprice > 150000) <> (nullif(o_orderstatus, 'P') = 'F') as ne from orders where (o_orderkey % 2 = 0) = true",
}
PAIRS |= {
    # NaN is one key, and so are the zeros.
    "agg_nan_keys": (
        "select case when isnan(k) then 'nan' when k = 0 then 'zero' else 'one' end as k, n, isnan(hi) as hi from (select k, count(*) as n, max(k) as hi from (select case o_orderkey % 4 when 0 then double('NaN') when 1 then -0.0D when 2 then 0.0D else 1.0D end as k from orders) t group by k) u",
        "select case o_orderkey % 4 when 0 then 'nan' when 3 then 'one' else 'zero' end as k, count(*) as n, bool_or(o_orderkey % 4 = 0) as hi from orders group by 1",
    ),
    "agg_nan_values": (
        "select o_orderstatus, isnan(sum(x)) as s, isnan(max(x)) as hi, round(min(x), 2) as lo, count(distinct x) as d from (select o_orderstatus, case when o_orderstatus = 'F' and o_orderkey % 7 = 0 then double('NaN') else o_totalprice end as x from orders) t group by o_orderstatus",
        "select o_orderstatus, bool_or(f) as s, bool_or(f) as hi, round(min(case when not f then o_totalprice end), 2) as lo, count(distinct case when not f then o_totalprice end) + max(case when f then 1 else 0 end) as d from (select *, o_orderstatus = 'F' and o_orderkey % 7 = 0 as f from orders) t group by o_orderstatus",
    ),
    "join_nan_keys": (
        "select count(*) as n from (select case when o_orderkey % 2 = 0 then double('NaN') else -0.0D end as k from orders) a join (select * from values (double('NaN')), (0.0D), (1.0D) as t(k)) b on a.k = b.k",
        "select count(*) as n from orders",
    ),
    "agg_regression_sums": (
        "select p_brand, round(regr_sxx(p_retailprice, p_size), 7) as sxx, round(regr_syy(p_retailprice, p_size), 7) as syy, round(regr_sxy(p_retailprice, p_size), 7) as sxy, round(stddev_pop(p_retailprice), 7) as sp, round(var_samp(p_retailprice), 7) as vs, round(stddev(p_size), 7) as sd, round(variance(p_size), 7) as v from part group by p_brand",
        "select p_brand, round(regr_sxx(p_retailprice, p_size), 7) as sxx, round(regr_syy(p_retailprice, p_size), 7) as syy, round(regr_sxy(p_retailprice, p_size), 7) as sxy, round(stddev_pop(p_retailprice), 7) as sp, round(var_samp(p_retailprice), 7) as vs, round(stddev(p_size), 7) as sd, round(variance(p_size), 7) as v from part group by p_brand",
    ),
    "fn_strings_more": (
        "select c_custkey, btrim(concat('  ', c_name, ' ')) as b, btrim(c_name, 'C#') as bc, concat('[', space(cast(c_custkey % 5 as int)), ']') as sp, ucase(c_name) as u, lcase(c_mktsegment) as l, trim(both 'B' from c_mktsegment) as t from customer",
        "select c_custkey, trim(concat('  ', c_name, ' ')) as b, trim(c_name, 'C#') as bc, concat('[', repeat(' ', cast(c_custkey % 5 as int)), ']') as sp, upper(c_name) as u, lower(c_mktsegment) as l, trim(c_mktsegment, 'B') as t from customer",
    ),
    "fn_shift_unsigned": (
        "select o_orderkey, shiftrightunsigned(-o_orderkey, 40) as a, -o_orderkey >>> 60 as b, cast(-o_orderkey as int) >>> 28 as c from orders",
        "select o_orderkey, cast(((18446744073709551616::hugeint - o_orderkey) % 18446744073709551616::hugeint) >> 40 as bigint) as a, cast(((18446744073709551616::hugeint - o_orderkey) % 18446744073709551616::hugeint) >> 60 as bigint) as b, cast(((4294967296 - o_orderkey) % 4294967296) >> 28 as int) as c from orders",
    ),
    "fn_micros": ("select event_id, unix_micros(cast(ts as timestamp)) as m from events", "select event_id, epoch_us(ts) as m from events"),
    "fn_decimal_division": (
        "select o_orderkey, cast(cast(o_totalprice as decimal(30,2)) / cast(o_custkey + 1 as decimal(20,0)) as decimal(30,4)) as q from orders",
        "select o_orderkey, cast(cast((round(o_totalprice * 100)::hugeint * 200 + o_custkey + 1) // (2 * (o_custkey + 1)) as decimal(30,0)) * 0.0001::decimal(5,4) as decimal(30,4)) as q from orders",
    ),
    "generate_map": (
        "select c_custkey, k, v from customer lateral view explode(map('nation', c_nationkey, 'key', cast(c_custkey % 100 as int))) t as k, v",
        "select c_custkey, 'nation' as k, c_nationkey as v from customer union all select c_custkey, 'key', cast(c_custkey % 100 as int) from customer",
    ),
    "generate_structs": (
        "select c_custkey, i, s.a as a, s.b as b from customer lateral view outer posexplode(case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then array(named_struct('a', c_nationkey, 'b', c_mktsegment), null) else array() end) t as i, s",
        "select c_custkey, null::int as i, null::int as a, null::varchar as b from customer where c_custkey % 3 <> 1 union all select c_custkey, 0, c_nationkey, c_mktsegment from customer where c_custkey % 3 = 1 union all select c_custkey, 1, null, null from customer where c_custkey % 3 = 1",
    ),
    "filter_nested_null": (
        "select k, s.a.b as b, s is null as sn, s.a is null as an, l is null as ln, l[0] is null as l0, m is not null as mn from (select o_orderkey as k, case when o_orderkey % 3 <> 0 then named_struct('a', case when o_orderkey % 3 = 2 then named_struct('b', o_custkey) end) end as s, case when o_orderkey % 2 = 0 then array(nullif(o_orderstatus, 'F')) end as l, case when o_orderkey % 5 = 0 then map('x', 1) end as m from orders) t where s.a.b is null or l is not null or m is null",
        "select k, case when k % 3 = 2 then o_custkey end as b, k % 3 = 0 as sn, k % 3 <> 2 as an, k % 2 <> 0 as ln, k % 2 <> 0 or o_orderstatus = 'F' as l0, k % 5 = 0 as mn from (select o_orderkey as k, * from orders) t where k % 3 <> 2 or k % 2 = 0 or k % 5 <> 0",
    ),
}
