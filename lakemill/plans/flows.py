"""Queries through files, the connector and streams, and DuckDB SQL for what comes out."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lakemill.session import shipped
from lakemill.sources import connector, ledger, scratch, tables
from lakemill.sources.scratch import place
from lakemill.streaming import events as stream
from lakemill.streaming import state, upserts


def file_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written and read in each format that has columns."""
    rows = tables.table(spark, folder, "customer")
    out = None
    for fmt in tables.FORMATS:
        if fmt != "text":
            more, path = {"rowTag": "row"} if fmt == "xml" else {}, place(spark, f"customer-{fmt}")
            tables.write(rows, path, fmt, **more)
            back = tables.read(spark, path, fmt, schema=rows.schema, **more)
            one = back.groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"), F.count_distinct("c_name").alias("names"), F.round(F.sum("c_acctbal"), 2).alias("balance")).withColumn("fmt", F.lit(fmt))
            out = one if out is None else out.unionByName(one)
    return out


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Names of parts written as lines of text and read again."""
    path = place(spark, "names")
    tables.write(tables.table(spark, folder, "part").select("p_name"), path, "text")
    return tables.read(spark, path, "text").groupBy(F.col("value").alias("name")).agg(F.count("*").alias("n"))


def partitioned_files(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in folders by status; the filter prunes folders before files are read."""
    path = place(spark, "orders")
    tables.write(tables.table(spark, folder, "orders"), path, partition_by=["o_orderstatus"])
    found = tables.read(spark, path).where("o_orderstatus <> 'P'")
    return found.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


def connected(spark: SparkSession, folder: str) -> DataFrame:
    """The connector's rows beside the nations that they number."""
    connector.register(spark)
    numbers = spark.read.format("numbers").option("rows", 25).option("parts", 4).load()
    return numbers.join(tables.table(spark, folder, "nation"), F.col("n") == F.col("n_nationkey")).select("n_name", "square", "even")


def ledger_commits(spark: SparkSession, folder: str) -> DataFrame:
    """Orders put into a table of our own format commit by commit, streamed on into another, and read with a filter that drops files."""
    ledger.register(spark)
    rows, path = tables.table(spark, folder, "orders"), place(spark, "ledger")
    for low, high in ((0, 100_000), (100_000, 250_000), (250_000, 1e18)):
        some = rows.where((F.col("o_totalprice") >= low) & (F.col("o_totalprice") < high))
        some.write.format("ledger").mode("append").save(f"{path}/orders")
    copied = spark.readStream.format("ledger").load(f"{path}/orders").writeStream.format("ledger").option("name", "copy").option("checkpointLocation", f"{path}/progress")
    copied.trigger(availableNow=True).start(f"{path}/copy").awaitTermination()
    found = ledger.read(spark, f"{path}/copy", ("o_totalprice", ">", 260_000.0))
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last_day"))


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files written from a table, found by name, length and time before any is opened, and read as bytes."""
    path = place(spark, "nations")
    tables.write(tables.table(spark, folder, "nation").select("n_regionkey", F.col("n_name").alias("value")), path, "text", partition_by=["n_regionkey"])
    found = tables.binary(spark, path, "*.txt", least_bytes=1, most_bytes=1 << 20)
    # a task may have written any number of files, so lines are what is compared
    lines = found.select("n_regionkey", F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("name")).where("name <> ''")
    return lines.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return stream.source(spark, f"{folder}/events.parquet")


def _streamed(df: DataFrame, keys: list[str], mode: str = "append") -> DataFrame:
    """What a stream wrote when all its input was read."""
    spark, path = df.sparkSession, place(df.sparkSession, "streamed")
    stream.batches_to(df, f"{path}/rows", keys, f"{path}/progress", mode)
    return stream.merged(spark, f"{path}/rows", df.schema, keys)


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Days that the watermark has passed."""
    found = stream.tumbling(_events(spark, folder), "ts", "1 day", ["event_type"], "value", late="1 hour")
    return _streamed(found, ["start", "event_type"]).select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that the watermark has passed."""
    found = stream.session_windows(_events(spark, folder), "ts", "1 hour", ["user_id"], "1 hour")
    return _streamed(found, ["start", "user_id"]).select("user_id", F.unix_micros("start").alias("began"), "n")


def stream_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Events that come from two sources, once each."""
    both = _events(spark, folder).unionByName(_events(spark, folder)).select("event_id", "user_id", "event_type", "ts")
    # on the way out nothing is made unique: each batch has a folder, and repeats would be counted
    found = stream.deduplicate(both, "ts", ["event_id"], "1 hour")
    path = place(spark, "streamed")
    stream.batches_to(found, f"{path}/rows", [], f"{path}/progress")
    return spark.read.parquet(f"{path}/rows").select("event_id", "user_id", "event_type")


def stream_join(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases of a user within an hour of a click."""
    clicks = _events(spark, folder).where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    buys = _events(spark, folder).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("buy_id"))
    found = stream.interval_join(clicks, buys, "user_id", "ts", "bought", "1 hour", "1 hour").select("click_id", "buy_id")
    return _streamed(found, ["click_id", "buy_id"])


def stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The last totals of each user, batch by batch, merged when they are read."""
    found = stream.running_totals(_events(spark, folder), "user_id", "value")
    return _streamed(found, ["user_id"], "update").select("user_id", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of a day, one every six hours, that the watermark has passed."""
    found = stream.tumbling(_events(spark, folder), "ts", "1 day", ["event_type"], "value", late="1 hour", slide="6 hours")
    return _streamed(found, ["start", "event_type"]).select(F.unix_micros("start").alias("began"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_timed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that a timer has closed, from state kept in a list."""
    with state.store(spark):
        found = _streamed(state.timed_sessions(_events(spark, folder), "user_id", "ts", datetime.timedelta(hours=1), "1 hour"), ["user_id", "began"])
    return found.select("user_id", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "n")


def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each user and type; that it was seen is forgotten after a day by the clock."""
    with state.store(spark, idle=False):
        return _streamed(state.first_seen(_events(spark, folder), ["user_id", "event_type"], "ts", datetime.timedelta(days=1)), ["event_id"]).select("user_id", "event_type", "event_id")


def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The last totals of each user, written batch by batch and merged level by level; few folders are read."""
    path = place(spark, "upserts")
    tables.table(spark, folder, "events").repartition(6, "event_id").write.parquet(f"{path}/in")
    totals = stream.running_totals(stream.source(spark, f"{path}/in", files_per_trigger=1), "user_id", "value")
    upserts.upsert_to(totals, f"{path}/rows", ["user_id"], f"{path}/progress", "update", every=2)
    return upserts.upserted(spark, f"{path}/rows", totals.schema, ["user_id"], every=2).select("user_id", "n", F.round("total", 4).alias("total"))


#: Rounds in which events arrive, and rounds by which each tenth event is late.
ROUNDS, ROUNDS_LATE = 6, 2


def stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """Events that arrive in rounds, some late: those kept, and how many were dropped behind the watermark.

    Each round is a folder of files that comes and is read before the next; what the
    watermark drops is counted by a listener.
    """
    path, rows = place(spark, "arrivals"), tables.table(spark, folder, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = rows.agg(F.min(micros).alias("a"), F.max(micros).alias("z"))
    share = (micros - span.select("a").scalar()) / (span.select("z").scalar() - span.select("a").scalar() + 1)
    arrivals = rows.withColumn("round", (F.floor(share * ROUNDS) + F.when(F.col("event_id") % 10 == 3, ROUNDS_LATE).otherwise(0)).cast("int"))
    dealt = scratch.cut(arrivals, "dealt")
    counts = []
    with stream.dropped_rows(spark) as dropped:
        for number in range(ROUNDS + ROUNDS_LATE):
            dealt.where(F.col("round") == number).write.mode("append").parquet(f"{path}/in")
            news = spark.readStream.schema(dealt.schema).parquet(f"{path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
            run = stream.batches_to(stream.deduplicate(news, "ts", ["event_id"], "1 day"), f"{path}/kept", [], f"{path}/progress")
            counts.append((number, dropped.of(run)))
    lost = spark.createDataFrame(counts, "round int, dropped long")
    kept = spark.read.schema(StructType([*dealt.schema, StructField("batch", LongType())])).parquet(f"{path}/kept")
    return lost.join(kept.groupBy("round").agg(F.count("*").alias("kept"), F.sum("event_id").alias("ids")), "round", "left").select("round", F.coalesce("kept", F.lit(0)).alias("kept"), "ids", "dropped")


QUERIES = {f.__name__: f for f in (file_formats, text_lines, partitioned_files, binary_files, stream_windows, stream_sessions, stream_distinct, stream_join, stream_sliding, stream_late)}
QUERIES |= {f.__name__: shipped(f) for f in (connected, ledger_commits, stream_totals, stream_upsert, stream_timed_sessions, stream_first_seen)}

ORACLE_SQL = {
    "file_formats": """
        select fmt, c_nationkey, count(*) as n, count(distinct c_name) as names, round(sum(c_acctbal), 2) as balance
        from customer, (select unnest(['parquet', 'orc', 'csv', 'json', 'xml']) as fmt) f group by fmt, c_nationkey""",
    "text_lines": "select p_name as name, count(*) as n from part group by p_name",
    "partitioned_files": "select o_orderstatus, o_orderpriority, count(*) as n, max(o_orderkey) as last_key from orders where o_orderstatus <> 'P' group by 1, 2",
    "connected": "select n_name, cast(n_nationkey as bigint) * n_nationkey as square, n_nationkey % 2 = 0 as even from nation where n_nationkey < 25",
    "ledger_commits": "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total, max(o_orderdate) as last_day from orders where o_totalprice > 260000 group by o_orderstatus",
    "binary_files": "select n_regionkey, count(*) as n, min(n_name) as first_name from nation group by n_regionkey",
    "stream_windows": """
        select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2
        having cast(ts as date) + interval 1 day <= (select max(ts) - interval 1 hour from events)""",
    "stream_sessions": """
        with a as (select *, case when ts > lag(ts) over (partition by user_id order by ts) + interval 1 hour then 1 else 0 end as fresh from events),
        b as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from a)
        select user_id, epoch_us(min(ts)) as began, count(*) as n from b group by user_id, session having max(ts) + interval 2 hour <= (select max(ts) from events)""",
    "stream_distinct": "select event_id, user_id, event_type from events",
    "stream_join": """
        select c.event_id as click_id, b.event_id as buy_id from events c join events b on c.user_id = b.user_id and b.ts between c.ts and c.ts + interval 1 hour
        where c.event_type = 'click' and b.event_type = 'purchase'""",
    "stream_sliding": """
        with w as (select event_type, value, unnest(range(4)) as i, time_bucket(interval 6 hour, ts) as b from events), s as (select *, b - i * interval 6 hour as start from w)
        select epoch_us(start) as began, event_type, count(*) as n, round(sum(value), 4) as total from s group by start, event_type having start + interval 1 day <= (select max(ts) - interval 1 hour from events)""",
    "stream_timed_sessions": """
        with a as (select *, case when ts > lag(ts) over (partition by user_id order by ts) + interval 1 hour then 1 else 0 end as fresh from events),
        b as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from a)
        select user_id, epoch_us(min(ts)) as began, epoch_us(max(ts)) as ended, count(*) as n from b group by user_id, session having max(ts) + interval 2 hour <= (select max(ts) from events)""",
    "stream_first_seen": "select user_id, event_type, arg_min(event_id, ts) as event_id from events group by user_id, event_type",
    "stream_late": f"""
        with e as (select *, cast(floor((epoch_us(ts) - min(epoch_us(ts)) over ()) / (max(epoch_us(ts)) over () - min(epoch_us(ts)) over () + 1)::double * {ROUNDS}) + case when event_id % 10 = 3 then {ROUNDS_LATE} else 0 end as int) as round from events),
        r as (select unnest(range({ROUNDS + ROUNDS_LATE}))::int as round),
        w as (select r.round, max(ts) - interval 1 day as mark from r left join e on e.round < r.round group by r.round)
        select w.round, count(*) filter (where mark is null or ts > mark) as kept, sum(event_id) filter (where mark is null or ts > mark)::bigint as ids, count(*) filter (where ts <= mark) as dropped from w left join e using (round) group by w.round""",
    "stream_upsert": "select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id",
    "stream_totals": "select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id",
}
