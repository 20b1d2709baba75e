"""The connector with a log of commits: what is there, what is read, and what failed tasks leave."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakemill.session import ship
from lakemill.sources import ledger, tables


@pytest.fixture
def table(spark, tmp_path):
    ship(spark)
    ledger.register(spark)
    return str(tmp_path / "t")


def put(df, path, mode="append"):
    df.write.format("ledger").mode(mode).save(path)


def test_rows_of_all_types_come_back(spark, table):
    df = spark.sql("select id, cast(id as int) as i, if(id % 3 = 0, null, id / 7) as x, concat('é', id) as s, date'2024-01-01' + cast(id as int) as d, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) as t, id % 2 = 0 as b, array(id, null) as a, struct(id as p, 'q' as q) as r, cast(id as decimal(9, 2)) as m from range(50)")
    put(df.repartition(3), table)
    back = spark.read.format("ledger").load(table)
    assert back.schema == df.schema or [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    assert sorted(back.collect(), key=repr) == sorted(df.collect(), key=repr)


def test_filters_drop_files_before_they_are_opened(spark, table):
    for i in range(6):
        put(spark.range(i * 100, i * 100 + 100).select("id", F.when(F.col("id") >= 300, F.concat(F.lit("n"), F.col("id"))).alias("s"), (F.col("id") / 3).alias("x"), F.expr("date'2024-01-01' + cast(id as int)").alias("d")).coalesce(1), table)
    reader = ledger.LedgerReader(table, True)
    names = lambda *wanted: (reader.pushFilters(list(wanted)), sum(len(p.names) for p in reader.partitions()))[1]
    assert names() == 6 and names(ledger.EqualTo(("id",), 250)) == 1 and names(ledger.GreaterThan(("id",), 399)) == 2 and names(ledger.LessThanOrEqual(("id",), 99)) == 1
    assert names(ledger.In(("id",), (5, 505))) == 2 and names(ledger.EqualTo(("s",), "n350")) == 1 and names(ledger.GreaterThanOrEqual(("x",), 100.0), ledger.LessThan(("x",), 130.0)) == 1
    assert names(ledger.EqualTo(("d",), datetime.date(2024, 1, 2))) == 1 and names(ledger.EqualTo(("other",), 1)) == 6 and names(ledger.EqualTo(("id",), None)) == 6
    log = ledger.Log(table)
    gone = next(f for f in log.known() if f["bounds"]["id"] == [0, 99])
    log.forget([gone["name"]])
    # an opened file that isn't there fails
    later = ledger.read(spark, table, ("id", ">=", 100))
    assert later.count() == 500 and later.where("id % 2 = 0").count() == 250 and later.where("id < 200").count() == 100 and later.count() == 500
    assert ledger.read(spark, table, ("id", ">", 100), ("s", "=", "n350")).count() == 1 and ledger.read(spark, table, ("id", ">", 5000)).count() == 0
    with pytest.raises(Exception, match="(?i)no such file|not exist|cannot open|failed"):
        ledger.read(spark, table).count()


def test_filters_of_one_query_never_reach_the_next(spark, table):
    for i in range(3):
        put(spark.range(i * 10, i * 10 + 10).coalesce(1), table)
    found = ledger.read(spark, table)
    assert [found.where("id >= 20").count(), found.count(), found.where("id < 5").count(), found.where("id % 2 = 0").count(), found.count()] == [10, 30, 5, 15, 30]


def test_a_failed_task_leaves_no_rows(spark, table):
    put(spark.range(10), table)
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        put(broken, table)
    assert spark.read.format("ledger").load(table).count() == 10
    log = ledger.Log(table)
    assert len(log.numbers()) == 1


def test_overwrites_replace_and_whole_entries_bound_what_is_read(spark, table, monkeypatch):
    log = ledger.Log(table)
    for i in range(23):
        log.append([{"name": f"f{i}", "rows": 1, "bytes": 1, "bounds": {}}], spark.range(1).schema, False)
    opened = []
    monkeypatch.setattr(ledger.Log, "entry", lambda self, n, real=ledger.Log.entry: opened.append(n) or real(self, n))
    assert [f["name"] for f in log.known()] == [f"f{i}" for i in range(23)] and len(opened) <= ledger.WHOLE_EVERY
    assert [f["name"] for f in log.known(12)] == [f"f{i}" for i in range(12)]
    put(spark.range(5), table, "overwrite")
    assert spark.read.format("ledger").load(table).count() == 5


def test_streams_read_on_and_write_each_batch_once(spark, table, tmp_path):
    put(spark.range(10), table)

    def copy():
        out = spark.readStream.format("ledger").load(table).writeStream.format("ledger").option("name", "copy").option("checkpointLocation", str(tmp_path / "c"))
        out.trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
        return spark.read.format("ledger").load(str(tmp_path / "o"))

    assert copy().count() == 10
    put(spark.range(10, 15), table)
    assert sorted(r.id for r in copy().collect()) == list(range(15)) and copy().count() == 15
    writer = ledger.LedgerStreamWriter(str(tmp_path / "o"), spark.range(1).schema, False, "copy")
    import pyarrow as pa

    again = writer.write(iter([pa.RecordBatch.from_pydict({"id": [1, 2]})]))
    writer.commit([again], 1)
    assert copy().count() == 15


def test_empty_tables_and_missing_ones(spark, table):
    put(spark.range(0), table)
    assert spark.read.format("ledger").load(table).count() == 0
    with pytest.raises(Exception, match="no table"):
        spark.read.format("ledger").load(table + "x").count()


def test_binary_files_are_chosen_by_name_length_and_time(spark, tmp_path):
    for name, content in (("a.bin", b"\x00\x01"), ("b.bin", b"x" * 100), ("c.txt", b"text")):
        (tmp_path / name).write_bytes(content)
    found = tables.binary(spark, str(tmp_path), "*.bin", most_bytes=50)
    assert [(r.length, bytes(r.content)) for r in found.collect()] == [(2, b"\x00\x01")]
    later = datetime.datetime.now() + datetime.timedelta(hours=1)
    assert tables.binary(spark, str(tmp_path), since=later).count() == 0
    assert "PushedFilters: [" in (plan := found._jdf.queryExecution().toString()) and "LessThanOrEqual(length,50)" in plan
