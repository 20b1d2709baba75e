"""Operators that stay spread out when one key, list or group holds most rows."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.operators import groups, joins, quantiles, vectors
from lakemill.session import ship


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_nearest(asked, given, k, size):
    def unit(v):
        if v is None or len(v) != size or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v) / max(map(abs, v))
        return x / np.linalg.norm(x)

    out = []
    for q, v in asked:
        if q is None or unit(v) is None:
            continue
        found = sorted(((-round(float(unit(v) @ unit(w)), 9), i) for i, w in given if i is not None and i != q and unit(w) is not None))[:k]
        out += [(q, r + 1, i, -c) for r, (c, i) in enumerate(found)]
    return sorted((q, r, i, round(c, 6)) for q, r, i, c in out)


def vector_table(n=300, size=6):
    r = random.Random(2)
    given = [(i, [r.choice([-1.0, 0.5, 0.25, 0.0, 2.0]) if i % 3 else r.gauss(0, 1) for _ in range(size)]) for i in range(n)]
    odd = [None, [], [0.0] * size, [1.0] * (size + 1), [float("nan")] * size, [float("inf"), *[1.0] * (size - 1)], [None, *[1.0] * (size - 1)], [1e200] * size, [1e-200] * size]
    return given + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, [1.0] * size)] + [(2000 + i, given[5][1]) for i in range(20)]


@pytest.mark.parametrize("blocks", [(1024, 4096, 64 << 20), (3, 7, 200)])
def test_nearest_vectors_equal_all_pairs(spark, monkeypatch, blocks):
    ship(spark)
    for name, value in zip(("BLOCK_QUERIES", "BLOCK_ROWS", "PART_BYTES"), blocks, strict=True):
        monkeypatch.setattr(vectors, name, value)
    given = vector_table()
    df = spark.createDataFrame(given, "id long, v array<double>").repartition(3)
    asked = [(i, v) for i, v in given if i is not None and (i % 100 == 5 or i in (1000, 1002, 1003, 1004, 1007))]
    got = vectors.nearest(df.where("id % 100 = 5 or id in (1000, 1002, 1003, 1004, 1007)"), df, 7, "id", "v")
    assert sorted((r.query_id, r.rank, r.other_id, round(r.cosine, 6)) for r in got.collect()) == plain_nearest(asked, given, 7, 6)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_nearest_vectors_of_few_and_none(spark):
    ship(spark)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "id long, v array<double>")
    assert rows(vectors.nearest(df, df, 5, "id", "v").select("query_id", "rank", "other_id")) == [(1, 1, 2), (2, 1, 1)]
    assert vectors.nearest(df.limit(0), df, 5, "id", "v").count() == 0 and vectors.nearest(df, df.limit(0), 5, "id", "v").count() == 0


def plain_quantile(values, p):
    values = sorted(values, key=lambda x: (math.isnan(x), x))
    spot = p * (len(values) - 1)
    low, high = values[math.floor(spot)], values[math.ceil(spot)]
    return low if math.floor(spot) == math.ceil(spot) else low + (high - low) * (spot - math.floor(spot))


def same(a, b):
    return a is None and b is None or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or a == b or math.isclose(a, b, rel_tol=1e-12)))


def test_quantiles_of_all_kinds_of_numbers(spark):
    ship(spark)
    r = random.Random(7)
    odd = [0.0, -0.0, 1e-310, -1e-310, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), 5.0, 5.0, 5.0, None]
    data = [("odd", x) for x in odd] + [("hot", r.choice([r.gauss(0, 1), r.gauss(0, 1e-9), float(r.randrange(5))])) for _ in range(2000)] + [(None, float(i)) for i in range(4)] + [("one", -3.5), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    shares = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}
    got = {x.k: x for x in quantiles.exact_quantiles(df, ["k"], "v", shares, {"e": 0.5, "f": 0.25}).collect()}
    assert set(got) == {k for k, _ in data}
    for k, found in got.items():
        values = [v for j, v in data if j == k and v is not None]
        assert found.n == len(values)
        ordered = sorted(values, key=lambda x: (math.isnan(x), x))
        for name, p in shares.items():
            assert same(found[name], plain_quantile(values, p) if values else None), (k, name, found[name])
        for name, p in {"e": 0.5, "f": 0.25}.items():
            assert same(found[name], ordered[max(0, math.ceil(p * len(values)) - 1)] if values else None)


def test_quantiles_without_keys_rows_or_sense(spark):
    ship(spark)
    df = spark.createDataFrame([(i, 1) for i in range(10)], "v int, k int")
    assert [tuple(r) for r in quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).collect()] == [(10, 4.5)]
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(df, [], "v", {"m": 1.5})


def test_no_task_of_quantiles_gets_the_values(spark):
    ship(spark)
    df = spark.range(100_000).select((F.col("id") % 3).cast("double").alias("v"), F.lit(1).alias("k"))
    plan = quantiles.exact_quantiles(df, ["k"], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median" not in plan


@pytest.mark.parametrize("left", [[1, 2, None], []])
@pytest.mark.parametrize("right", [[1, 3], [1, None], [None], []])
def test_not_in_is_that_of_sql(spark, left, right):
    a, b = spark.createDataFrame([(x,) for x in left], "x int"), spark.createDataFrame([(x,) for x in right], "y int")
    want = spark.sql("select * from {a} where x not in (select y from {b})", a=a, b=b)
    assert rows(joins.not_in(a, b, "x", "y")) == rows(want)


def test_not_in_broadcasts_nothing_where_that_is_off(spark, data):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts, lines = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("part", "lineitem"))
        assert "Broadcast" not in joins.not_in(parts, lines, "p_partkey", "l_partkey")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moments(n, seed, keys):
    r = random.Random(seed)
    start = datetime.datetime(2024, 3, 1)
    return [(r.choice(keys), start + datetime.timedelta(seconds=r.choice([r.randrange(400_000), r.randrange(50) * 3600])) if r.random() < 0.97 else None, i) for i in range(n)]


@pytest.mark.parametrize("bucket", ["1 hour", "7 hours", "90 days"])
def test_as_of_by_time_equals_one_window(spark, bucket):
    left = spark.createDataFrame(moments(400, 1, ["hot"] * 8 + ["b", None]), "k string, t timestamp, id int").repartition(3)
    right = spark.createDataFrame([(*m, m[2] % 7) for m in moments(150, 2, ["hot"] * 5 + ["b", None, "c"])], "k string, at timestamp, v int, w int").where("at is not null")
    got = joins.as_of_join_by_time(left, right, ["k"], "t", "at", ["v", "w"], bucket, "r_")
    want = joins.as_of_join(left.where("t is not null"), right, ["k"], "t", "at", ["v", "w"], "r_")
    assert rows(got.where("t is not null")) == rows(want) and {(r.r_v, r.r_w) for r in got.where("t is null").collect()} == {(None, None)}
    assert got.columns == want.columns and got.count() == 400


@pytest.mark.parametrize("bucket", ["30 minutes", "5 hours", "90 days"])
@pytest.mark.parametrize("gap", ["20 minutes", "1 hour"])
def test_sessions_by_time_equal_one_window(spark, bucket, gap):
    df = spark.createDataFrame(moments(500, 3, ["hot"] * 9 + ["b", None]), "k string, t timestamp, id int").repartition(3)
    got = groups.sessions_by_time(df, "k", "t", gap, bucket)
    want = groups.sessions(df.where("t is not null"), "k", "t", gap, ["id"])
    assert rows(got.where("t is not null")) == rows(want) and {r.session for r in got.where("t is null").collect()} == {None}
    assert got.count() == 500


def test_one_key_of_all_rows_is_several_tasks_work(spark):
    start = datetime.datetime(2024, 1, 1)
    df = spark.range(2000).select(F.lit("only").alias("k"), (F.lit(start) + F.expr("make_interval(0, 0, 0, 0, 0, id)")).cast("timestamp").alias("t"), "id")
    keyed = df.withColumn("bucket", groups.stretch("t", "6 hours"))
    assert keyed.groupBy("k", "bucket").count().agg(F.max("count")).first()[0] <= 361
    plan = groups.sessions_by_time(df, "k", "t", "1 minute", "6 hours")._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and groups.sessions_by_time(df, "k", "t", "1 minute", "6 hours").agg(F.max("session")).first()[0] == 0


def test_salted_joins_read_a_written_table(spark):
    large = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = joins.salted_join(large, spark.range(2).select(F.col("id").alias("k")), "k", 3)._jdf.queryExecution().toString()
    assert "salted-" in plan
