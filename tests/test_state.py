"""Streams with state: timers, expiry, late rows that are counted, upserts that are merged."""

import datetime
import os
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakemill.session import ship
from lakemill.streaming import events, state, upserts


def at(minutes, seconds=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes, seconds=seconds)


def files(spark, folder, batches, schema):
    """A folder with a file for each batch, read one by one in this order."""
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part{i}"))
        (f,) = (folder / f"part{i}").glob("*.parquet")
        (folder / "in").mkdir(exist_ok=True)
        os.utime(f.rename(folder / "in" / f"{i}.parquet"), (1e9 + i, 1e9 + i))
    return str(folder / "in")


def test_timers_close_sessions_whose_rows_come_in_any_order(spark, tmp_path):
    ship(spark)
    schema = "user long, ts timestamp, n int"
    batches = [
        # out of order, a tie, a gap of just an hour, and one of a second more
        [(1, at(70), 1), (1, at(10), 2), (1, at(10), 3), (1, at(130, 1), 4), (2, at(0), 5), (None, at(5), 6), (2, None, 7)],
        [(1, at(190), 8), (2, at(59), 9), (3, at(500), 10)],
        # what joins two open sessions
        [(3, at(620), 11), (4, at(500), 12)], [(3, at(560), 13), (5, at(2000), 14)], [(5, at(2001), 15)],
    ]
    source = events.source(spark, files(spark, tmp_path / "f", batches, schema), files_per_trigger=1)
    with state.store(spark):
        events.batches_to(state.timed_sessions(source, "user", "ts", datetime.timedelta(hours=1), "10 hours"), str(tmp_path / "o"), [], str(tmp_path / "c"))
    got = sorted((r.user, r.began, r.ended, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [(1, at(10), at(70), 3), (1, at(130, 1), at(190), 2), (2, at(0), at(59), 2), (3, at(500), at(620), 3), (4, at(500), at(500), 1)]


def test_the_session_gets_its_own_store_back(spark):
    before = spark.conf.get(state.STORE[0], None)
    with pytest.raises(ZeroDivisionError), state.store(spark, idle=False):
        assert spark.conf.get(state.STORE[0]) == state.STORE[1] and spark.conf.get(state.IDLE) == "false"
        raise ZeroDivisionError
    assert spark.conf.get(state.STORE[0], None) == before and spark.conf.get(state.IDLE) == "true"


def test_what_was_seen_is_forgotten_when_its_time_is_over(spark, tmp_path):
    ship(spark)
    schema = "k string, ts timestamp, n int"
    folder = files(spark, tmp_path / "f", [[("a", at(2), 1), ("a", at(1), 2), ("b", at(3), 3)]], schema)

    def run():
        with state.store(spark, idle=False):
            found = state.first_seen(events.source(spark, folder), ["k"], "ts", datetime.timedelta(seconds=15))
            events.batches_to(found, str(tmp_path / "o"), [], str(tmp_path / "c"))
        return sorted((r.batch, r.k, r.n) for r in spark.read.option("basePath", str(tmp_path / "o")).parquet(str(tmp_path / "o")).collect())

    assert run() == [(0, "a", 2), (0, "b", 3)]
    files(spark, tmp_path / "g", [[("a", at(9), 4), ("c", at(9), 5)]], schema)
    os.rename(tmp_path / "g" / "in" / "0.parquet", tmp_path / "f" / "in" / "1.parquet")
    began = time.time()
    second = run()
    if time.time() - began < 10:
        assert second == [(0, "a", 2), (0, "b", 3), (1, "c", 5)]
    time.sleep(16)
    files(spark, tmp_path / "h", [[("a", at(10), 6)]], schema)
    os.rename(tmp_path / "h" / "in" / "0.parquet", tmp_path / "f" / "in" / "2.parquet")
    assert (2, "a", 6) in run()


def test_a_listener_counts_rows_behind_the_watermark(spark, tmp_path):
    schema = "id long, ts timestamp"
    folder = files(spark, tmp_path / "f", [[(1, at(0)), (2, at(600))]], schema)
    run = lambda counter: counter.of(events.batches_to(events.deduplicate(events.source(spark, folder), "ts", ["id"], "1 hour"), str(tmp_path / "o"), [], str(tmp_path / "c")))
    with events.dropped_rows(spark) as counter:
        assert run(counter) == 0
        files(spark, tmp_path / "g", [[(3, at(10)), (4, at(541)), (5, at(540)), (6, at(539))]], schema)
        os.rename(tmp_path / "g" / "in" / "0.parquet", tmp_path / "f" / "in" / "1.parquet")
        assert run(counter) == 3
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2, 4]


def test_folders_read_stay_few_over_many_batches(spark, tmp_path):
    levels, want = upserts.Levels(spark, str(tmp_path / "u"), 3), {}
    schema = spark.createDataFrame([], "k int, v long").schema
    most = 0
    for number in range(40):
        rows = [(k if k else None, number * 100 + k) for k in range(number % 4, 12, 1 + number % 5)]
        want.update(rows)
        levels.add(spark.createDataFrame(rows, schema).coalesce(1), number, ["k"])
        most = max(most, len(levels.covering(levels.last())))
        if number in (0, 8, 26, 31, 39):
            got = upserts.upserted(spark, str(tmp_path / "u"), schema, ["k"], every=3).collect()
            assert dict(map(tuple, got)) == want and len(got) == len(want)
    # at most two of each of four levels, where there are 40 batches
    assert most <= 8 and len(levels.covering(39)) == 4
    # a batch that is written again, and a merge that didn't end
    levels.add(spark.createDataFrame([(99, 1)], schema).coalesce(1), 39, ["k"])
    os.remove(tmp_path / "u" / "level2-upto35" / "_SUCCESS")
    assert [f.rsplit("/", 1)[1] for f in levels.covering(39)] == ["level3-upto26", "level1-upto29", "level1-upto32", "level1-upto35", "level1-upto38", "level0-upto39"]
    assert 99 in {r.k for r in upserts.upserted(spark, str(tmp_path / "u"), schema, ["k"], every=3).collect()}


def test_no_batches_and_no_sense(spark, tmp_path):
    assert upserts.upserted(spark, str(tmp_path / "none"), spark.range(1).schema, ["id"]).count() == 0
    with pytest.raises(ValueError):
        upserts.Levels(spark, str(tmp_path), 1)


def test_user_functions_over_odd_rows(spark, monkeypatch):
    from lakemill.functions import udfs

    ship(spark)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), ("b", None)], "k string, v double")
    assert sorted(map(tuple, udfs.demeaned(df, "k", "v").collect()), key=repr) == sorted([("a", -1.0), ("a", 1.0), (None, -1.0), (None, 1.0), ("b", None)], key=repr)
    shares = udfs.shares_within(df.where("v is not null"), "k", "v", "s", bucket_rows=2)
    assert sorted((r.k, round(r.s, 6)) for r in shares.where("k is not null").collect()) == [("a", 0.25), ("a", 0.75)]
    assert [r.n for r in df.select(F.col("v"), udfs.banded(2.0, 3)("v").alias("n")).orderBy("v").collect()] == [None, 0, 1, 2, 2]
    spark.udtf.register("words_of", udfs.Words)
    text = spark.createDataFrame([(" two  words ",), ("",), (None,), ("one",)], "t string").repartition(2)
    assert sorted(map(tuple, spark.sql("select * from words_of(table(select t from {t}))", t=text).collect())) == [(0, "one"), (0, "two"), (1, "words")]


def test_totals_are_added_up_without_a_call_for_each_key(spark, tmp_path):
    given = [[("a", at(1), 1.5), ("a", at(2), None), ("b", at(1), None), (None, at(1), 2.0)], [("a", at(3), 2.0), ("c", at(3), float("nan")), (None, at(4), 1.0)]]
    folder = files(spark, tmp_path / "f", given, "k string, ts timestamp, v double")
    totals = events.running_totals(events.source(spark, folder, files_per_trigger=1), "k", "v")
    assert "Pandas" not in totals._jdf.queryExecution().logical().toString()
    upserts.upsert_to(totals, str(tmp_path / "u"), ["k"], str(tmp_path / "c"), "update", every=2)
    got = upserts.upserted(spark, str(tmp_path / "u"), totals.schema, ["k"], every=2).collect()
    assert {tuple(r) for r in got} == {("a", 3, 3.5), ("b", 1, 0.0), ("c", 1, 0.0), (None, 2, 3.0)}


def test_first_rows_are_chosen_among_rows_not_frames():
    class Seen:
        def exists(self):
            return False

        def update(self, value):
            assert value == (True,)

    first = state.FirstSeen("ts", datetime.timedelta(days=1))
    first.seen = Seen()
    given = [Row(k="a", ts=None, n=1), Row(k="a", ts=datetime.datetime(2024, 1, 2), n=2), Row(k="a", ts=datetime.datetime(2024, 1, 1), n=3), Row(k="a", ts=datetime.datetime(2024, 1, 1), n=4)]
    assert [r.n for r in first.handleInputRows(("a",), iter(given), None)] == [3]
    assert [r.n for r in first.handleInputRows(("a",), iter(given[:1]), None)] == [1]
