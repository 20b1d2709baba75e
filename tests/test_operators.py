import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lakemill.functions import scalars
from lakemill.operators import groups, joins
from lakemill.plans import functions, relational


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_as_of_join_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 9, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 40), (None, 1, 99)], "k string, t int, v int")
    assert rows(joins.as_of_join(left, right, ["k"], "t", "t", ["v"]).select("id", "v")) == [(1, 50), (2, None), (3, None), (4, None)]


def test_range_join_equals_a_nested_loop(spark):
    points = spark.range(200).select((F.col("id") * 1.7).alias("p"))
    ranges = spark.range(30).select(F.col("id").alias("r"), (F.col("id") * 11.0).alias("a"), (F.col("id") * 11.0 + F.col("id") * 3).alias("b"))
    found = joins.range_join(points, ranges, "p", "a", "b", 25)
    assert rows(found.select("p", "r")) == rows(points.join(ranges, F.col("p").between(F.col("a"), F.col("b"))).select("p", "r"))
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()


def test_range_join_within_keys(spark):
    points = spark.createDataFrame([("x", 5.0), ("y", 5.0), ("z", 5.0)], "k string, p double")
    ranges = spark.createDataFrame([("x", 1, 0.0, 9.0), ("y", 2, 6.0, 9.0)], "k string, r int, a double, b double")
    assert rows(joins.range_join(points, ranges, "p", "a", "b", 4, by=["k"]).select("k", "r")) == [("x", 1)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_a_plain_one(spark, how):
    large = spark.createDataFrame([(k, i) for i in range(50) for k in ("hot", "hot", f"k{i % 5}", None)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3)], "k string, v int")
    assert rows(joins.salted_join(large, small, "k", 4, how)) == rows(large.join(small, "k", how))


def test_salted_join_refuses_kinds_that_would_repeat_rows(spark):
    with pytest.raises(ValueError):
        joins.salted_join(spark.range(1), spark.range(1), "id", 2, "full")


def test_sessions_part_at_gaps(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("a", at(21)), ("b", at(1))], "k string, t timestamp")
    assert [r.session for r in groups.sessions(df, "k", "t", "10 minutes").orderBy("k", "t").collect()] == [0, 0, 1, 0]


def test_latest_per_key_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), (None, 1, "z")], "k string, v int, p string")
    assert rows(groups.latest_per_key(df, ["k"], ["v"])) == rows(spark.createDataFrame([("a", 2, "y"), (None, 1, "z")], "k string, v int, p string"))


def test_fill_days_carries_on(spark):
    d = lambda n: datetime.date(2024, 1, n)
    df = spark.createDataFrame([("a", d(1), 5), ("a", d(4), 7)], "k string, day date, n int")
    assert [r.n for r in groups.fill_days(df, "k", "day", "n").orderBy("day").collect()] == [5, 5, 5, 7]


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    top = groups.top_per_key(df, ["k"], [F.desc("id")], 2)
    assert rows(top.select("k", "id")) == [(0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_distinct_counts(spark):
    df = spark.createDataFrame([("a", i % 7) for i in range(100)] + [("b", None)], "k string, v int")
    assert rows(groups.distinct_per_key(df, ["k"], "v", "n")) == [("a", 7), ("b", 0)]


def test_scalars(spark):
    df = spark.createDataFrame([("  two words ", "http://A.b:80/x", [3.0, 4.0]), ("", "", []), (None, None, None)], "t string, u string, a array<float>")
    got = df.select(scalars.tokens(F.col("t")), scalars.host(F.col("u")), scalars.dot(F.col("a"), F.col("a")), scalars.ratio(F.lit(1), F.lit(0))).collect()
    assert [tuple(r) for r in got] == [(2, "a.b", 25.0, None), (0, "", 0.0, None), (0, None, None, None)]


def test_salts_part_rows_that_are_equal(spark):
    large, small = spark.createDataFrame([("hot", 1)] * 40, "k string, v int").coalesce(1), spark.createDataFrame([("hot", 2)], "k string, w int")
    found = joins.salted_join(large, small, "k", 4)
    assert found.count() == 40 and "monotonically_increasing_id" in found._jdf.queryExecution().toString()


def test_a_join_by_nested_loops_gives_the_same_rows(spark):
    a, b = spark.range(9).withColumnRenamed("id", "a"), spark.range(4, 12).withColumnRenamed("id", "b")
    assert rows(a.join(b.hint("shuffle_replicate_nl"), a.a == b.b)) == rows(a.join(b, a.a == b.b)) and a.join(b.hint("shuffle_replicate_nl"), a.a == b.b).count() == 5


def test_best_rows_of_ties_are_those_of_the_smallest_key(spark, tmp_path):
    given = [(k, nation, float(k % 3)) for nation in (1, 2) for k in range(nation * 100, nation * 100 + 30)] + [(1, 1, None), (None, 2, 99.0), (None, 2, -99.0), (5, 3, None)]
    df = spark.createDataFrame(given, "c_custkey long, c_nationkey long, c_acctbal double")
    # the largest keys come first, in files of their own
    df.orderBy(F.desc_nulls_last("c_custkey")).repartitionByRange(5, F.desc("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create table customer as select * from '{tmp_path}/customer.parquet/*.parquet' order by c_custkey")
    want = sorted(con.execute(relational.ORACLE_SQL["agg_arg_best"]).fetchall())
    assert rows(relational.QUERIES["agg_arg_best"](spark, str(tmp_path))) == want == [(1, 101, 102), (2, 200, 201), (3, None, None)]


@pytest.mark.parametrize("most", [1000, 30, 7])
def test_broadcasts_in_parts_equal_a_join(spark, most):
    a = spark.createDataFrame([(i % 50 if i % 9 else None, i) for i in range(300)], "a long, x long")
    b = spark.createDataFrame([(i % 40 if i % 11 else None, i) for i in range(90)], "b long, y long")
    got = joins.broadcast_join(a, b, "a", "b", most)
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == -(-90 // most)
    assert rows(got) == rows(a.join(b.hint("merge"), F.col("a") == F.col("b")))


def test_each_hint_joins_orders_with_customers(spark, data):
    n = spark.read.parquet(f"{data}/orders.parquet").count()
    found = functions.join_hints(spark, data)
    assert rows(found.select("strategy", "n")) == [("broadcast", n), ("merge", n), ("shuffle_hash", n)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(f"{kind} [o_custkey" in plan for kind in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin"))
