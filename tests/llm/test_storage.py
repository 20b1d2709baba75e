from types import SimpleNamespace

import pytest

from lakemill.llm import storage


class Settings(dict):
    def set(self, k, v):
        self[k] = v


def session(master, **settings):
    return SimpleNamespace(conf=Settings(settings), sparkContext=SimpleNamespace(master=master))


def test_the_cluster_names_the_folder():
    assert storage.shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(session(master))


def test_one_process_gets_a_folder_once():
    local = session("local[4]")
    assert storage.shared_dir(local) == storage.shared_dir(local)


def test_cut_keeps_rows_and_schema_and_drop_removes_them(spark):
    df = spark.createDataFrame([(1, [1.0, None], None), (None, None, b"x")], "a long, b array<double>, c binary")
    one = storage.cut(df, "t")
    assert one.schema == df.schema and sorted(map(str, one.collect())) == sorted(map(str, df.collect()))
    assert storage.cut(df.limit(0), "t").count() == 0
    assert "Scan parquet" in one._jdf.queryExecution().toString()
    storage.drop(one)
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        one.collect()
