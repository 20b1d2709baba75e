"""A connector of our own that needs no files: a table of numbers, made in parallel by a batch reader."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Numbers(DataSource):
    """``spark.read.format("numbers").option("rows", n).option("parts", p)``: n, its square, its parity."""

    @classmethod
    def name(cls) -> str:
        return "numbers"

    def schema(self) -> str:
        return "n long, square long, even boolean"

    def reader(self, schema) -> DataSourceReader:
        return NumbersReader(int(self.options.get("rows", 100)), int(self.options.get("parts", 4)))


class NumbersReader(DataSourceReader):
    def __init__(self, rows: int, parts: int):
        self.rows, self.parts = rows, max(1, parts)

    def partitions(self) -> list[InputPartition]:
        step = -(-self.rows // self.parts)
        return [InputPartition((a, min(self.rows, a + step))) for a in range(0, self.rows, step or 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b = partition.value
        for n in range(a, b):
            yield n, n * n, n % 2 == 0


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Numbers)
