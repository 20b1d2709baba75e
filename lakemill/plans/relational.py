"""Relational queries as SQL that Spark and DuckDB both read; tables stand in braces."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.sources.tables import table

#: Query name to SQL. Names in braces are tables.
SQL: dict[str, str] = {
    "filter_project": """
        select l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) as net
        from {lineitem} where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1997-04-01' and l_quantity between 5 and 10""",
    "flagship_revenue": """
        select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as n_orders
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey
        join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
        where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' group by r_name, n_name""",
    "pricing_summary": """
        select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base,
        round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_discount), 6) as avg_disc, count(*) as n
        from {lineitem} where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""",
    "join_left": "select o_orderkey, count(l_orderkey) as n_lines from {orders} left join {lineitem} on o_orderkey = l_orderkey group by o_orderkey",
    "join_right": "select p_partkey, round(coalesce(sum(l_quantity), 0), 2) as qty from {lineitem} right join {part} on l_partkey = p_partkey group by p_partkey",
    "join_full": """
        select coalesce(c_nationkey, s_nationkey) as nation, nc, ns from (select c_nationkey, count(*) as nc from {customer} where c_acctbal > 5000 group by c_nationkey) c
        full outer join (select s_nationkey, count(*) as ns from {supplier} where s_acctbal > 8000 group by s_nationkey) s on c_nationkey = s_nationkey""",
    "join_semi": "select c_custkey, c_name from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey and o_totalprice > 300000)",
    "join_anti": "select o_orderkey from {orders} where not exists (select 1 from {lineitem} where l_orderkey = o_orderkey)",
    "join_cross": "select r_name, mkt from {region} cross join (select distinct c_mktsegment as mkt from {customer}) m",
    "join_theta": "select count(*) as n, round(sum(s_acctbal - t.bal), 2) as gap from {supplier} join (select n_nationkey, n_nationkey * 200.0 as bal from {nation}) t on s_acctbal > t.bal and s_nationkey < t.n_nationkey",
    "join_self": "select a.n_name as one, b.n_name as two from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "join_lateral": """
        select c_custkey, o_orderkey, o_totalprice from {customer} cross join lateral
        (select o_orderkey, o_totalprice from {orders} where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) t""",
    "subquery_scalar": "select o_orderkey, o_totalprice from {orders} where o_totalprice > (select avg(o_totalprice) * 1.8 from {orders})",
    "subquery_correlated": """
        select s_suppkey, s_name from {supplier} s where s_acctbal > (select avg(t.s_acctbal) from {supplier} t where t.s_nationkey = s.s_nationkey)""",
    "cte": """
        with per_cust as (select o_custkey, count(*) as n, sum(o_totalprice) as total from {orders} group by o_custkey),
        ranked as (select *, rank() over (order by total desc, o_custkey) as r from per_cust) select o_custkey, n, round(total, 2) as total, cast(r as bigint) as r from ranked where r <= 20""",
    "cte_recursive": """
        with recursive s as (select l_linenumber as k, count(*) as n from {lineitem} group by l_linenumber),
        t(k, n, total) as (select k, n, n from s where k = 1 union all select s.k, s.n, t.total + s.n from s join t on s.k = t.k + 1)
        select k, n, total from t""",
    "agg_having": "select o_custkey, count(*) as n, round(max(o_totalprice), 2) as top from {orders} group by o_custkey having count(*) > 12",
    "agg_distinct": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as supps, round(sum(distinct l_tax), 4) as taxes from {lineitem} group by l_returnflag",
    "agg_filter": """
        select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_orderstatus <> 'F') as open, cast(sum(case when o_totalprice > 150000 then 1 else 0 end) as bigint) as large
        from {orders} group by o_orderpriority""",
    "agg_statistics": """
        select l_linestatus, round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_discount), 8) as vp, round(corr(l_quantity, l_extendedprice), 6) as r, round(covar_pop(l_tax, l_discount), 8) as cv,
        round(skewness(l_quantity), 4) as sk from {lineitem} group by l_linestatus""",
    "agg_median": "select l_returnflag, round(median(l_extendedprice), 4) as med from {lineitem} group by l_returnflag",
    "agg_arg_best": "select c_nationkey, max_by(c_custkey, c_acctbal) as richest, min_by(c_custkey, c_acctbal) as poorest from {customer} group by c_nationkey",
    "agg_bool_bits": "select c_mktsegment, bool_and(c_acctbal > -1000) as every_one, bool_or(c_acctbal > 9990) as any_one, bit_xor(c_custkey) as bits from {customer} group by c_mktsegment",
    "grouping_sets": """
        select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as int) as g1, cast(grouping(l_linestatus) as int) as g2, count(*) as n from {lineitem}
        group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "rollup": "select r_name, n_name, count(*) as n from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
    "cube": "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from {orders} group by cube (o_orderstatus, o_orderpriority)",
    "window_rank": """
        select s_suppkey, cast(rank() over w as bigint) as r, cast(dense_rank() over w as bigint) as d, cast(row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as bigint) as n,
        round(percent_rank() over w, 8) as p, round(cume_dist() over w, 8) as c, cast(ntile(4) over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as bigint) as t
        from {supplier} window w as (partition by s_nationkey order by s_acctbal desc)""",
    "window_lag_lead": """
        select event_id, user_id, lag(event_type) over w as before, lead(event_type, 2, 'none') over w as later, first_value(event_id) over w as first_id, nth_value(event_id, 2) over w as second_id
        from {events} window w as (partition by user_id order by ts)""",
    "window_rows": "select event_id, round(sum(value) over (partition by user_id order by ts rows between 3 preceding and current row), 4) as moving from {events}",
    "window_range": "select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as n from {events}",
    "top_k": "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 25",
    "top_k_offset": "select c_custkey, c_acctbal from {customer} order by c_acctbal desc, c_custkey limit 10 offset 10",
    "set_union": "select c_nationkey as k from {customer} union select s_nationkey from {supplier}",
    "set_union_all": "select 'c' as kind, c_nationkey as k, count(*) as n from {customer} group by c_nationkey union all select 's', s_nationkey, count(*) from {supplier} group by s_nationkey",
    "set_intersect": "select o_custkey as k from {orders} where o_orderstatus = 'F' intersect select o_custkey from {orders} where o_orderstatus = 'O'",
    "set_intersect_all": "select l_partkey as k from {lineitem} where l_quantity > 48 intersect all select l_partkey from {lineitem} where l_quantity < 3",
    "set_except": "select p_partkey as k from {part} except select l_partkey from {lineitem} where l_quantity > 40",
    "set_except_all": "select l_suppkey as k from {lineitem} where l_returnflag = 'R' except all select l_suppkey from {lineitem} where l_returnflag = 'A'",
    "distinct": "select distinct o_orderstatus, o_orderpriority from {orders}",
    "string_functions": """
        select p_partkey, upper(p_brand) as up, cast(length(p_name) as bigint) as len, substring(p_type, 1, 4) as head, replace(p_name, ' ', '_') as snake, reverse(p_brand) as back, md5(p_name) as digest,
        lpad(cast(p_size as varchar(10)), 4, '0') as padded, trim(concat('  ', p_type, ' ')) as trimmed, case when p_name like '%a%' then 1 else 0 end as has_a from {part}""",
    "date_functions": """
        select o_orderkey, cast(extract(year from o_orderdate) as int) as y, cast(extract(quarter from o_orderdate) as int) as q, cast(extract(month from o_orderdate) as int) as m, cast(extract(week from o_orderdate) as int) as w,
        cast(date_trunc('month', o_orderdate) as date) as month_start, cast(last_day(o_orderdate) as date) as month_end, cast(o_orderdate + interval 10 day as date) as later from {orders}""",
    "math_functions": """
        select l_orderkey, l_linenumber, l_quantity, cast(floor(l_extendedprice / 7) as bigint) as f, cast(ceil(l_discount * 10) as bigint) as c, round(sqrt(l_extendedprice), 6) as s, round(ln(l_extendedprice), 6) as l, round(exp(l_tax), 6) as e,
        cast(l_partkey % 7 as bigint) as m, abs(l_quantity - 25) as a, cast(sign(l_quantity - 25) as double) as g, greatest(l_tax, l_discount) as hi, least(l_tax, l_discount) as lo, round(power(l_quantity, 2), 4) as sq from {lineitem}""",
    "conditional_functions": """
        select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') as seg, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'rich' end as band from {customer}""",
    "null_semantics": """
        select k, v is null as missing, coalesce(v, -1) as filled, v = 1 as is_one from (select o_custkey as k, nullif(cast(o_custkey % 3 as int), 2) as v from {orders}) t where v is distinct from 0""",
    "values_list": "select n_name, t.tag from {nation} join (values (0, 'zero'), (1, 'one'), (4, 'four')) as t(k, tag) on n_regionkey = t.k",
}

TABLE = re.compile(r"\{(\w+)\}")


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    names = sorted(set(TABLE.findall(sql)))
    return lambda spark, folder: spark.sql(sql, **{n: table(spark, folder, n) for n in names})


#: Spark's own text where the shared one leaves ties open: the first row of the table's order by key counts, as in DuckDB on one thread, which passes over nulls on either side.
SPARK_SQL = SQL | {
    "agg_arg_best": """
        select c_nationkey, max_by(c_custkey, struct(c_acctbal, ~c_custkey)) filter (where c_acctbal is not null and c_custkey is not null) as richest,
        min_by(c_custkey, struct(c_acctbal, c_custkey)) filter (where c_acctbal is not null and c_custkey is not null) as poorest from {customer} group by c_nationkey""",
}
QUERIES = {name: _query(sql) for name, sql in SPARK_SQL.items()}
ORACLE_SQL = {name: TABLE.sub(r"\1", sql) for name, sql in SQL.items()}
