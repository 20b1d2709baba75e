from pyspark.sql import functions as F

from lakemill.plans import functions
from lakemill.sources.tables import table


def test_sketches_are_near_the_truth(spark, data):
    rows = table(spark, data, "lineitem")
    exact = {r[0]: r for r in rows.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"), F.median("l_extendedprice").alias("median")).collect()}
    for r in functions.approximate(spark, data).collect():
        want = exact[r.l_returnflag]
        assert abs(r.orders / want.orders - 1) < 0.1 and abs(r.parts / want.parts - 1) < 0.1 and abs(r.median / want.median - 1) < 0.01


def test_added_sketches_count_as_the_whole(spark, data):
    events = table(spark, data, "events")
    exact = {r[0]: r[1] for r in events.groupBy(F.date_trunc("month", F.to_date("ts"))).agg(F.countDistinct("user_id")).collect()}
    for r in functions.sketch_union(spark, data).collect():
        assert abs(r.users / exact[r.month] - 1) < 0.05
