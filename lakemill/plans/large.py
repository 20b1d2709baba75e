"""Queries that stay spread out when one key, list or group holds most rows, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.operators import groups, joins, quantiles, vectors
from lakemill.session import shipped
from lakemill.sources.tables import table


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors most alike each one whose id is divisible by 100."""
    rows = table(spark, folder, "embeddings")
    return vectors.nearest(rows.where("vec_id % 100 = 0"), rows, 10, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


def large_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    found = quantiles.exact_quantiles(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"low": 0.1, "median": 0.5, "high": 0.999}, {"quarter": 0.25, "most": 1.0})
    return found.select("l_returnflag", "l_linestatus", "n", *(F.round(c, 4).alias(c) for c in ("low", "median", "high", "quarter", "most")))


def quantiles_of_all(spark: SparkSession, folder: str) -> DataFrame:
    """One group of all rows, with few different values and a null for each fifth."""
    rows = table(spark, folder, "lineitem").select(F.when(F.col("l_partkey") % 5 > 0, -F.col("l_quantity")).alias("v"))
    return quantiles.exact_quantiles(rows, [], "v", {"median": 0.5, "p90": 0.9}, {"first": 0.0})


def join_not_in(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that no large line sells."""
    lines = table(spark, folder, "lineitem").where("l_quantity > 45 and l_partkey is not null")
    return joins.not_in(table(spark, folder, "part"), lines, "p_partkey", "l_partkey").select("p_partkey")


def join_not_in_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """The same of a list that holds nulls: none."""
    lines = table(spark, folder, "lineitem").select(F.when(F.col("l_quantity") > 45, F.col("l_partkey")).alias("key"))
    return joins.not_in(table(spark, folder, "part"), lines, "p_partkey", "key").agg(F.count("*").alias("n"))


def not_in_large(spark: SparkSession, folder: str) -> DataFrame:
    """NOT IN a list without nulls, with one, and an empty list, of customers whose key is null for each seventh."""
    customers = table(spark, folder, "customer").select(F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey")).alias("key"), "c_nationkey")
    orders = table(spark, folder, "orders").where("o_totalprice > 250000")
    some = F.when(F.col("o_custkey") % 11 > 0, F.col("o_custkey"))
    lists = {"whole": orders.select("o_custkey"), "nulls": orders.select(some.alias("o_custkey")), "empty": orders.where("o_totalprice < 0").select("o_custkey")}
    out = None
    for name, right in lists.items():
        one = joins.not_in(customers, right, "key", "o_custkey").select(F.lit(name).alias("list"), F.col("key"), "c_nationkey")
        out = one if out is None else out.unionByName(one)
    return out


def as_of_by_time(spark: SparkSession, folder: str) -> DataFrame:
    """For each click the last purchase by anyone: one key has all rows."""
    events = table(spark, folder, "events").withColumn("site", F.lit(1))
    clicks = events.where("event_type = 'click'").select("site", "event_id", "ts")
    buys = events.where("event_type = 'purchase'").select("site", F.col("ts").alias("bought"), F.col("event_id").alias("buy_id"))
    return joins.as_of_join_by_time(clicks, buys, ["site"], "ts", "bought", ["buy_id"], "2 days").select("event_id", "buy_id")


def sessions_by_time(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each kind of event, which are few and large."""
    found = groups.sessions_by_time(table(spark, folder, "events").select("event_type", "ts", "event_id"), "event_type", "ts", "90 minutes", "6 hours")
    return found.groupBy("event_type", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that several documents have: counted by digest, map-side first, so that texts don't move."""
    found = table(spark, folder, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return found.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


QUERIES = {f.__name__: shipped(f) for f in (nearest_vectors, large_quantiles, quantiles_of_all, join_not_in, join_not_in_nulls, not_in_large, as_of_by_time, sessions_by_time, exact_duplicates)}

_AT = "quantile_cont(l_extendedprice, {})"
ORACLE_SQL = {
    "nearest_vectors": """
        with v as (select vec_id, cast(embedding as double[]) as e from embeddings)
        select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, v.e), 9) desc, v.vec_id) as int) as rank, v.vec_id as other_id, round(list_cosine_similarity(q.e, v.e), 6) as cosine
        from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0 qualify rank <= 10""",
    "large_quantiles": f"""
        select l_returnflag, l_linestatus, count(*) as n, round({_AT.format(0.1)}, 4) as low, round({_AT.format(0.5)}, 4) as median, round({_AT.format(0.999)}, 4) as high,
        quantile_disc(l_extendedprice, 0.25) as quarter, max(l_extendedprice) as most from lineitem group by 1, 2""",
    "quantiles_of_all": """
        with v as (select case when l_partkey % 5 > 0 then -l_quantity end as v from lineitem)
        select count(v) as n, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.9) as p90, min(v) as first from v""",
    "join_not_in": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45 and l_partkey is not null)",
    "join_not_in_nulls": "select count(*) as n from part where p_partkey not in (select case when l_quantity > 45 then l_partkey end from lineitem)",
    "not_in_large": """
        with c as (select case when c_custkey % 7 > 0 then c_custkey end as key, c_nationkey from customer), o as (select * from orders where o_totalprice > 250000)
        select 'whole' as list, key, c_nationkey from c where key not in (select o_custkey from o)
        union all select 'nulls', key, c_nationkey from c where key not in (select case when o_custkey % 11 > 0 then o_custkey end from o)
        union all select 'empty', key, c_nationkey from c where key not in (select o_custkey from o where o_totalprice < 0)""",
    "as_of_by_time": """
        select c.event_id, b.event_id as buy_id from (select * from events where event_type = 'click') c asof left join (select * from events where event_type = 'purchase') b on c.ts >= b.ts""",
    "sessions_by_time": """
        with a as (select *, case when ts > lag(ts) over (partition by event_type order by ts) + interval 90 minute then 1 else 0 end as fresh from events),
        b as (select *, cast(sum(fresh) over (partition by event_type order by ts) as bigint) as session from a)
        select event_type, session, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from b group by event_type, session""",
    "exact_duplicates": "select sha256(coalesce(text, '')) as digest, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents group by 1 having count(*) > 1",
}
