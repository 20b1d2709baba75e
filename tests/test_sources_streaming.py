import os

import pytest
from pyspark.sql import functions as F

from lakemill.session import SETTINGS, ship
from lakemill.sources import connector, tables
from lakemill.streaming import events


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json", "xml"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.range(20).select("id", (F.col("id") % 3).cast("string").alias("part"), (F.col("id") / 3).alias("x"))
    more = {"rowTag": "row"} if fmt == "xml" else {}
    tables.write(df, str(tmp_path / "t"), fmt, **more)
    back = tables.read(spark, str(tmp_path / "t"), fmt, schema=df.schema, **more)
    assert sorted(back.collect()) == sorted(df.collect())


def test_partitioned_write_prunes(spark, tmp_path):
    df = spark.range(30).select("id", (F.col("id") % 3).cast("int").alias("part"))
    tables.write(df, str(tmp_path / "t"), partition_by=["part"])
    found = tables.read(spark, str(tmp_path / "t")).where("part = 1")
    assert found.count() == 10 and "PartitionFilters: [isnotnull(part" in found._jdf.queryExecution().toString()


def test_unknown_formats_and_missing_schemas(spark):
    with pytest.raises(ValueError):
        tables.read(spark, "x", "nope")
    with pytest.raises(ValueError):
        tables.read(spark, "x", "csv")
    with pytest.raises(ValueError):
        tables.write(spark.range(1), "x", "nope")


def test_scan_pushes_filters_and_columns(spark, data):
    plan = tables.table(spark, data, "lineitem").where("l_quantity > 30").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_connector(spark):
    ship(spark)
    connector.register(spark)
    found = spark.read.format("numbers").option("rows", 10).option("parts", 3).load()
    assert found.rdd.getNumPartitions() == 3 and found.agg(F.sum("square")).first()[0] == 285


def test_streamed_windows_equal_batch(spark, data, tmp_path):
    stream = events.tumbling(events.source(spark, f"{data}/events.parquet"), "ts", "1 day", ["event_type"], "value")
    events.drain(stream, "w", "complete", str(tmp_path / "c"))
    batch = events.tumbling(spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"], "value")
    tidy = lambda d: sorted(map(tuple, d.select("start", "event_type", "n", F.round("total", 6)).collect()))
    assert tidy(spark.table("w")) == tidy(batch)


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    hours = "select explode(sequence(timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 05:00:00', interval 1 hour)) as ts, 'a' as k, 1.0 as v"
    late = "select timestamp'2024-01-01 00:10:00' as ts, 'a' as k, 1.0 as v"
    end = "select timestamp'2024-01-02 00:00:00' as ts, 'b' as k, 1.0 as v"
    # what a batch lets go is late for the batch after the next
    between = "select timestamp'2024-01-01 05:30:00' as ts, 'b' as k, 1.0 as v"
    for i, sql in enumerate((hours, between, late, end)):
        spark.sql(sql).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    (tmp_path / "e").mkdir()
    for i in range(4):
        (f,) = (tmp_path / f"part{i}").glob("*.parquet")
        os.utime(f.rename(tmp_path / "e" / f"{i}.parquet"), (1e9 + i, 1e9 + i))
    stream = events.tumbling(events.source(spark, str(tmp_path / "e"), files_per_trigger=1), "ts", "1 hour", ["k"], "v", late="30 minutes")
    events.drain(stream, "late", "append", str(tmp_path / "c"))
    assert [(r.k, r.n) for r in spark.table("late").where("k = 'a'").orderBy("start").collect()] == [("a", 1)] * 6


def test_sessions_dedup_join_and_state(spark, data, tmp_path):
    one = events.source(spark, f"{data}/events.parquet")
    events.drain(events.session_windows(one, "ts", "1 hour", ["user_id"], "1 hour"), "s", "append", str(tmp_path / "1"))
    assert spark.table("s").agg(F.sum("n")).first()[0] <= 1000
    events.drain(events.deduplicate(one, "ts", ["event_id"], "1 hour"), "d", "append", str(tmp_path / "2"))
    assert spark.table("d").count() == 1000
    two = events.source(spark, f"{data}/events.parquet").select(F.col("user_id").alias("user_id"), F.col("ts").alias("ts2"), F.col("event_id").alias("id2"))
    events.drain(events.interval_join(one, two, "user_id", "ts", "ts2", "1 hour", "1 hour"), "j", "append", str(tmp_path / "3"))
    flat = spark.read.parquet(f"{data}/events.parquet")
    want = flat.alias("a").join(flat.alias("b"), F.expr("a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 1 hour")).count()
    assert spark.table("j").count() == want
    events.drain(events.running_totals(one, "user_id", "value"), "r", "update", str(tmp_path / "4"))
    assert spark.table("r").agg(F.sum("n")).first()[0] == 1000


def test_batches_written_twice_count_once(spark, data, tmp_path):
    events.batches_to(events.source(spark, f"{data}/events.parquet"), str(tmp_path / "o"), ["event_id"], str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1000


def test_a_key_that_comes_again_has_its_last_row(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, sql in enumerate(("select 1 as k, 'old' as v union all select 2, 'stays' union all select null, 'x'", "select 1 as k, 'new' as v union all select 3, 'comes' union all select null, 'y'")):
        spark.sql(sql).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (f,) = (tmp_path / f"part{i}").glob("*.parquet")
        os.utime(f.rename(tmp_path / "in" / f"{i}.parquet"), (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema("k int, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.batches_to(stream, str(tmp_path / "o"), ["k"], str(tmp_path / "c"))
    found = events.merged(spark, str(tmp_path / "o"), stream.schema, ["k"])
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "new"), (2, "stays"), (3, "comes"), (None, "y")]


def test_settings_keep_adaptive_plans():
    assert SETTINGS["spark.sql.adaptive.enabled"] == "true"


def test_files_that_are_read_whole_have_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_OF_FILE", 10)
    df = spark.range(35).select("id", F.concat(F.lit("n"), "id").alias("name")).coalesce(1)
    for fmt, files in (("xml", 4), ("json", 1)):
        path, more = str(tmp_path / fmt), {"rowTag": "row"} if fmt == "xml" else {}
        tables.write(df, path, fmt, **more)
        assert len([p for p in (tmp_path / fmt).iterdir() if p.name.startswith("part-")]) == files
        assert sorted(map(tuple, tables.read(spark, path, fmt, schema=df.schema, **more).collect())) == sorted(map(tuple, df.collect()))
