from pyspark.sql import functions as F

from lakemill.llm.keys import row_key


def test_halves_of_a_row_key_do_not_follow_from_each_other(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("t"))
    r = df.select(row_key(F.col("id"), F.col("t")).alias("k"), F.unhex(F.lpad(F.hex(F.xxhash64("id", "t", F.lit(1))), 16, "0")).alias("onward")).collect()
    assert len({x.k for x in r}) == 50 and all(len(x.k) == 16 for x in r)
    # a hash that starts from the first half is what must not be the second
    assert not any(bytes(x.onward) == bytes(x.k[8:]) for x in r)


def test_row_keys_tell_which_column_is_null(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), (None, None), ("x", "x"), ("", "x"), ("x", "")], "a string, b string")
    assert df.select(row_key(F.col("a"), F.col("b")).alias("k")).distinct().count() == 6
