"""Queries over function families: percentiles, sketches, maps, variants, user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions import udfs
from lakemill.operators import groups, joins
from lakemill.session import shipped
from lakemill.sources import scratch
from lakemill.sources.tables import table


def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    sql = """select l_returnflag, round(percentile_cont(0.9) within group (order by l_quantity), 4) as p90, percentile_disc(0.25) within group (order by l_quantity) as q25,
             mode() within group (order by l_linenumber) as usual_line, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from {lineitem} group by l_returnflag"""
    return spark.sql(sql, lineitem=table(spark, folder, "lineitem"))


def approximate(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches: no exact answer to compare; tests bound their errors."""
    rows = table(spark, folder, "lineitem")
    return rows.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("median")
    )


def sketch_union(spark: SparkSession, folder: str) -> DataFrame:
    """A rollup of sketches: daily sketches of users, added up to months without the events."""
    daily = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", 14).alias("sketch"))
    return daily.groupBy(F.date_trunc("month", "day").alias("month")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))


#: Entries that a theta sketch keeps, as a power of 2, and items of a KLL sketch: small, so that what they give are estimates.
THETA, KLL = 11, 400
#: How far estimates may be off: of counts, a share of the union's, five standard errors; of ranks, about three.
THETA_BOUND, KLL_BOUND = 5 / 2 ** (THETA / 2), 0.02


def stored_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with lines of two ship modes' flags, by stored sketches that are united and intersected; each estimate beside the truth and whether it is near enough."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey")
    path = scratch.place(spark, "sketches")
    lines.groupBy("l_returnflag", "l_linestatus").agg(F.theta_sketch_agg("l_orderkey", THETA).alias("sketch")).write.parquet(path)
    stored = spark.read.parquet(path)
    flags = stored.groupBy("l_returnflag").agg(F.theta_union_agg("sketch").alias("s"))
    pairs = flags.alias("a").join(flags.alias("b"), F.col("a.l_returnflag") < F.col("b.l_returnflag")).select(
        F.col("a.l_returnflag").alias("one"), F.col("b.l_returnflag").alias("two"), F.theta_sketch_estimate(F.theta_intersection("a.s", "b.s")).alias("both"), F.theta_sketch_estimate(F.theta_union("a.s", "b.s")).alias("either")
    )
    kinds = lines.select("l_returnflag", "l_orderkey").distinct()
    left, right = kinds.select(F.col("l_returnflag").alias("one"), "l_orderkey"), kinds.select(F.col("l_returnflag").alias("two"), "l_orderkey")
    shared = left.join(right, "l_orderkey").where("one < two").groupBy("one", "two").agg(F.count("*").alias("exact_both"))
    sizes = kinds.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    exact = shared.join(sizes.select(F.col("l_returnflag").alias("one"), F.col("n").alias("n1")), "one").join(sizes.select(F.col("l_returnflag").alias("two"), F.col("n").alias("n2")), "two")
    exact = exact.withColumn("exact_either", F.col("n1") + F.col("n2") - F.col("exact_both"))
    near = lambda estimate, truth: F.abs(F.col(estimate) - F.col(truth)) <= THETA_BOUND * F.col("exact_either")
    return pairs.join(exact, ["one", "two"]).select("one", "two", "exact_both", "exact_either", near("both", "exact_both").alias("both_near"), near("either", "exact_either").alias("either_near"))


def rank_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles by KLL sketches made by month and merged by flag: whether the share of rows up to each is what was asked for."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", F.date_trunc("month", "l_shipdate").alias("month"), "l_extendedprice")
    monthly = lines.groupBy("l_returnflag", "month").agg(F.kll_sketch_agg_double("l_extendedprice", KLL).alias("s"))
    merged = monthly.groupBy("l_returnflag").agg(F.kll_merge_agg_double("s").alias("s"))
    asked = merged.select("l_returnflag", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("s", F.lit(p)).alias("q")) for p in (0.1, 0.5, 0.9)))).alias("x")).select("l_returnflag", "x.*")
    ranks = lines.join(asked, "l_returnflag").groupBy("l_returnflag", "p").agg(F.count("*").alias("n"), F.avg((F.col("l_extendedprice") <= F.col("q")).cast("double")).alias("share"))
    return ranks.select("l_returnflag", "p", "n", (F.abs(F.col("share") - F.col("p")) <= KLL_BOUND).alias("near"))


def maps(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    by_user = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    frequent = F.map_filter("m", lambda k, v: v >= 5)
    return by_user.select("user_id", F.size("m").cast("long").alias("kinds"), F.array_join(F.array_sort(F.map_keys(frequent)), ",").alias("frequent"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"))


def variants(spark: SparkSession, folder: str) -> DataFrame:
    value = F.parse_json("props")
    return table(spark, folder, "events").groupBy((F.variant_get(value, "$.k", "long") % 7).alias("r")).agg(F.count("*").alias("n"))


def structs(spark: SparkSession, folder: str) -> DataFrame:
    packed = table(spark, folder, "nation").select(F.struct("n_nationkey", F.struct(F.col("n_name").alias("name")).alias("inner")).alias("s"), "n_regionkey")
    listed = packed.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("s")).alias("all"))
    return listed.select("n_regionkey", F.expr("all[0].inner.name").alias("first_name"), F.size("all").cast("long").alias("n"), F.array_max(F.transform("all", lambda s: s.n_nationkey)).alias("last_key"))


def arrow_function(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select("n_nationkey", F.length(udfs.title(F.lower("n_name"))).cast("long").alias("len"), F.lower(udfs.title("n_name")).alias("name"))


def pandas_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.round(udfs.clipped_mean("c_acctbal"), 4).alias("mean"))


def table_function(spark: SparkSession, folder: str) -> DataFrame:
    spark.udtf.register("words_of", udfs.Words)
    sql = "select word, count(*) as n, min(position) as first_place from words_of(table(select p_name from {part})) group by word"
    return spark.sql(sql, part=table(spark, folder, "part"))


def grouped_map(spark: SparkSession, folder: str) -> DataFrame:
    """Each order line's share of its order."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return udfs.shares_within(rows, "l_orderkey", "l_extendedprice", "share").withColumn("share", F.round("share", 6))


def scalar_pandas(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", udfs.initials("p_name").alias("initials"))


def iterator_pandas(spark: SparkSession, folder: str) -> DataFrame:
    """Parts in each price band."""
    band = udfs.banded(150.0, 12)
    return table(spark, folder, "part").groupBy(band("p_retailprice").alias("band")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


def difference_from_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return udfs.demeaned(rows, "s_nationkey", "s_acctbal").select("s_suppkey", F.round("s_acctbal", 4).alias("diff"))


def partition_map(spark: SparkSession, folder: str) -> DataFrame:
    return udfs.running_counts(table(spark, folder, "lineitem"), "l_linenumber")


def transpose(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "region").select("r_name", F.length("r_name").cast("long").alias("len"), F.col("r_regionkey").cast("long").alias("r_regionkey"))
    return groups.transposed(found, "r_name")


def join_hints(spark: SparkSession, folder: str) -> DataFrame:
    """One join of whole tables by each strategy that scales: all give the same rows."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    out = None
    for hint in ("broadcast", "merge", "shuffle_hash"):
        if hint == "broadcast":
            joined = joins.broadcast_join(orders, customers, "o_custkey", "c_custkey")
        else:
            joined = orders.join(customers.hint(hint), F.col("o_custkey") == F.col("c_custkey"))
        one = joined.agg(F.count("*").alias("n")).withColumn("strategy", F.lit(hint))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (percentiles, approximate, sketch_union, stored_sketches, rank_sketches, maps, variants, structs, transpose, join_hints)}
QUERIES |= {f.__name__: shipped(f) for f in (arrow_function, pandas_aggregate, table_function, grouped_map, partition_map, scalar_pandas, iterator_pandas, difference_from_mean)}

ORACLE_SQL = {
    "percentiles": """
        select l_returnflag, round(percentile_cont(0.9) within group (order by l_quantity), 4) as p90, percentile_disc(0.25) within group (order by l_quantity) as q25,
        (select l_linenumber from lineitem m where m.l_returnflag = t.l_returnflag group by l_linenumber order by count(*) desc, l_linenumber limit 1) as usual_line,
        round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem t group by l_returnflag""",
    "stored_sketches": """
        with k as (select distinct l_returnflag, l_orderkey from lineitem), n as (select l_returnflag, count(*) as n from k group by 1),
        b as (select a.l_returnflag as one, b.l_returnflag as two, count(*) as exact_both from k a join k b on a.l_orderkey = b.l_orderkey and a.l_returnflag < b.l_returnflag group by 1, 2)
        select one, two, exact_both, x.n + y.n - exact_both as exact_either, true as both_near, true as either_near from b join n x on one = x.l_returnflag join n y on two = y.l_returnflag""",
    "rank_sketches": "select l_returnflag, p, count(*) as n, true as near from lineitem, (select unnest([0.1::double, 0.5::double, 0.9::double]) as p) q group by 1, 2",
    "maps": """
        with c as (select user_id, event_type, count(*) as n from events group by 1, 2)
        select user_id, count(*) as kinds, coalesce(string_agg(event_type, ',' order by event_type) filter (where n >= 5), '') as frequent, coalesce(max(n) filter (where event_type = 'click'), 0) as clicks from c group by user_id""",
    "variants": "select cast(json_extract_string(props, '$.k') as bigint) % 7 as r, count(*) as n from events group by 1",
    "structs": "select n_regionkey, arg_min(n_name, n_nationkey) as first_name, count(*) as n, max(n_nationkey) as last_key from nation group by n_regionkey",
    "arrow_function": "select n_nationkey, length(n_name) as len, lower(n_name) as name from nation",
    "pandas_aggregate": """
        with r as (select c_mktsegment, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal) - 1 as i, count(*) over (partition by c_mktsegment) as n from customer)
        select c_mktsegment, round(avg(c_acctbal), 4) as mean from r where i >= n // 10 and i < n - n // 10 group by c_mktsegment""",
    "table_function": """
        select word, count(*) as n, cast(min(i) as int) as first_place from (select unnest(w) as word, unnest(range(len(w))) as i from (select string_split(p_name, ' ') as w from part) a) t group by word""",
    "grouped_map": "select l_orderkey, l_partkey, l_extendedprice, round(l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey), 6) as share from lineitem",
    "scalar_pandas": "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') as initials from part",
    "iterator_pandas": "select cast(least(floor(p_retailprice / 150), 11) as bigint) as band, count(*) as n, min(p_partkey) as first_key from part group by 1",
    "difference_from_mean": "select s_suppkey, round(s_acctbal - avg(s_acctbal) over (partition by s_nationkey), 4) as diff from supplier",
    "partition_map": "select l_linenumber, count(*) as n from lineitem group by l_linenumber",
    "transpose": """
        select 'len' as key, max(length(r_name)) filter (where r_name = 'AFRICA') as "AFRICA", max(length(r_name)) filter (where r_name = 'AMERICA') as "AMERICA", max(length(r_name)) filter (where r_name = 'ASIA') as "ASIA",
        max(length(r_name)) filter (where r_name = 'EUROPE') as "EUROPE", max(length(r_name)) filter (where r_name = 'MIDDLE EAST') as "MIDDLE EAST" from region union all
        select 'r_regionkey', max(cast(r_regionkey as bigint)) filter (where r_name = 'AFRICA'), max(r_regionkey) filter (where r_name = 'AMERICA'), max(r_regionkey) filter (where r_name = 'ASIA'),
        max(r_regionkey) filter (where r_name = 'EUROPE'), max(r_regionkey) filter (where r_name = 'MIDDLE EAST') from region""",
    "join_hints": """
        with t as (select count(*) as n from orders join customer on o_custkey = c_custkey)
        select n, unnest(['broadcast', 'merge', 'shuffle_hash']) as strategy from t""",
}
