"""Queries written with the DataFrame API and this library's operators, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions import scalars
from lakemill.operators import groups, joins
from lakemill.sources.tables import table
from lakemill.streaming import events as stream


def as_of(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("buy_id"))
    return joins.as_of_join(clicks, buys, ["user_id"], "ts", "bought", ["buy_id"]).select("event_id", "buy_id")


def range_join(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    bands = table(spark, folder, "nation").select("n_nationkey", (F.col("n_nationkey") * 40 + 900).cast("double").alias("low"), (F.col("n_nationkey") * 40 + 960).cast("double").alias("high"))
    return joins.range_join(parts, bands, "p_retailprice", "low", "high", 50).select("p_partkey", "n_nationkey")


def salted_join(spark: SparkSession, folder: str) -> DataFrame:
    large = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    small = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return joins.salted_join(large, small, "k", 8).groupBy("n_name").agg(F.count("*").alias("n"))


def top_per_key(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return groups.top_per_key(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).withColumn("rank", F.col("rank").cast("long"))


def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return groups.latest_per_key(table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def sessionize(spark: SparkSession, folder: str) -> DataFrame:
    found = groups.sessions(table(spark, folder, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "1 hour", ["event_id"])
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def fill_days(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return groups.fill_days(days, "user_id", "day", "n").select("user_id", "day", "n")


def distinct_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return groups.distinct_per_key(table(spark, folder, "events"), ["event_type"], "user_id", "users")


def pivot(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return found.select("o_orderpriority", *(F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c.lower()}") for c in "FOP"))


def unpivot(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_discount"), 2).alias("discount"))
    return lines.unpivot("l_returnflag", ["quantity", "discount"], "what", "value")


def ordered_names(spark: SparkSession, folder: str) -> DataFrame:
    sql = "select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from {nation} group by n_regionkey"
    return spark.sql(sql, nation=table(spark, folder, "nation"))


def json_paths(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").groupBy(F.pmod(k, F.lit(10)).alias("digit")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def arrays_and_maps(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("p_name", " ")
    long_words = F.filter(words, lambda w: F.length(w) > 4)
    return table(spark, folder, "part").select(
        "p_partkey", F.size(words).cast("long").alias("n"), F.size(long_words).cast("long").alias("n_long"), F.array_join(F.array_sort(words), "|").alias("ordered"), F.element_at(words, 1).alias("head"),
        F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)).cast("long").alias("letters"),
    )


def explode_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def text_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", scalars.tokens(F.col("text")).cast("long").alias("tokens"), F.length("text").cast("long").alias("chars"))


def array_norms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.round(scalars.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


def url_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").groupBy(scalars.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Regular expressions: tags taken out, white space folded, an address looked for, pieces counted."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))
    found = table(spark, folder, "pages").select("page_id", "url", text.alias("text"))
    return found.select("page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), F.col("text").rlike("[A-Za-z0-9._]+@[a-z0-9.]+").alias("has_address"), F.size(F.split("url", "[/.]")).cast("long").alias("pieces"))


def date_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks, days of the week (Monday is 1), differences, times of day, parsed and formatted dates."""
    at = F.col("ts")
    return table(spark, folder, "events").select(
        "event_id", F.to_date(F.date_trunc("week", at)).alias("week"), (F.weekday(at) + 1).cast("long").alias("iso_day"), F.dayofyear(at).cast("long").alias("day_of_year"), F.hour(at).cast("long").alias("h"), F.minute(at).cast("long").alias("m"),
        F.datediff(at, F.lit("2020-02-29").cast("date")).cast("long").alias("days"), F.date_format(at, "yyyy/MM/dd").alias("written"), F.to_date(F.date_format(at, "ddMMyyyy"), "ddMMyyyy").alias("parsed"),
    )


def conversation_shape(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"))
    return found.groupBy("turns", "last_role").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = stream.tumbling(rows, "ts", "2 days", ["event_type"], "value", slide="1 day")
    return found.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        as_of, range_join, salted_join, top_per_key, latest_per_key, sessionize, fill_days, distinct_per_key, pivot, unpivot, ordered_names, json_paths, arrays_and_maps, explode_words, text_lengths,
        array_norms, url_hosts, conversation_shape, page_text, date_parts, sliding_windows,
    )
}

ORACLE_SQL = {
    "as_of": """
        select c.event_id, b.event_id as buy_id from (select * from events where event_type = 'click') c
        asof left join (select * from events where event_type = 'purchase') b on c.user_id = b.user_id and c.ts >= b.ts""",
    "range_join": "select p_partkey, n_nationkey from part join nation on p_retailprice between n_nationkey * 40 + 900 and n_nationkey * 40 + 960",
    "salted_join": "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name",
    "top_per_key": """
        select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 3""",
    "latest_per_key": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "sessionize": """
        with a as (select *, case when ts > lag(ts) over (partition by user_id order by ts, event_id) + interval 1 hour then 1 else 0 end as fresh from events),
        b as (select *, cast(sum(fresh) over (partition by user_id order by ts, event_id) as bigint) as session from a)
        select user_id, session, count(*) as n, min(event_id) as first_id from b group by user_id, session""",
    "fill_days": """
        with d as (select user_id, cast(ts as date) as day, count(*) as n from events group by 1, 2),
        s as (select user_id, cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from d group by user_id)
        select s.user_id, s.day, last_value(n ignore nulls) over (partition by s.user_id order by s.day rows between unbounded preceding and current row) as n
        from s left join d on s.user_id = d.user_id and s.day = d.day""",
    "distinct_per_key": "select event_type, count(distinct user_id) as users from events group by event_type",
    "pivot": """
        select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) filter (where o_orderstatus = 'O') as n_o, count(*) filter (where o_orderstatus = 'P') as n_p
        from orders group by o_orderpriority""",
    "unpivot": """
        with t as (select l_returnflag, round(sum(l_quantity), 2) as quantity, round(sum(l_discount), 2) as discount from lineitem group by l_returnflag)
        select l_returnflag, 'quantity' as what, quantity as value from t union all select l_returnflag, 'discount', discount from t""",
    "ordered_names": "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey",
    "json_paths": """
        select cast(k % 10 as bigint) as digit, count(*) as n, cast(sum(k) as bigint) as total from (select cast(json_extract_string(props, '$.k') as bigint) as k from events) t group by 1""",
    "arrays_and_maps": """
        select p_partkey, len(w) as n, len(list_filter(w, lambda x: length(x) > 4)) as n_long, array_to_string(list_sort(w), '|') as ordered, w[1] as head, cast(list_sum(list_transform(w, lambda x: length(x))) as bigint) as letters
        from (select p_partkey, string_split(p_name, ' ') as w from part) t""",
    "explode_words": "select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) t group by word",
    "text_lengths": r"""
        select conv_id, turn, case when trim(text) = '' then 0 else len(regexp_split_to_array(trim(text), '\s+')) end as tokens, length(text) as chars from conversations""",
    "array_norms": "select vec_id, round(list_inner_product(cast(embedding as double[]), cast(embedding as double[])), 6) as norm from embeddings",
    "url_hosts": "select lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host, count(*) as n from pages group by 1",
    "page_text": r"""
        with t as (select page_id, url, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text from pages)
        select page_id, length(text) as chars, md5(text) as digest, regexp_matches(text, '[A-Za-z0-9._]+@[a-z0-9.]+') as has_address, len(regexp_split_to_array(url, '[/.]')) as pieces from t""",
    "date_parts": """
        select event_id, cast(date_trunc('week', ts) as date) as week, isodow(ts) as iso_day, dayofyear(ts) as day_of_year, hour(ts) as h, minute(ts) as m, date_diff('day', date '2020-02-29', cast(ts as date)) as days,
        strftime(ts, '%Y/%m/%d') as written, cast(ts as date) as parsed from events""",
    "conversation_shape": """
        with c as (select conv_id, count(*) as turns, max_by(role, turn) as last_role, sum(length(text)) as chars from conversations group by conv_id)
        select turns, last_role, count(*) as n, cast(sum(chars) as bigint) as chars from c group by turns, last_role""",
    "sliding_windows": """
        select cast(d as date) as day, event_type, count(*) as n, round(sum(value), 4) as total
        from (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as d, event_type, value from events) t
        group by 1, 2""",
}
