"""A connector for tables of Parquet files that a log of commits names: the format ``ledger``, or :func:`read`.

Rows are there once their commit is in the log, all of them at once; files of tasks or jobs that failed are
in no commit and never read. Each entry of the log says what the smallest and largest values of a
file's columns are, so that filters drop files before they are opened, and streams read on from the last commit they
know. The folder has to be one that the driver and all executors reach by a path or address
that pyarrow's file systems know (local, HDFS, S3, GCS). There is one writer at a time.
"""

from __future__ import annotations

import dataclasses
import datetime
import json
import math
import operator
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Each entry of the log of so many says what all before it say, too, so that a reader opens no more than these.
WHOLE_EVERY = 10
#: Bytes of files that a task reads, about.
TASK_BYTES = 128 << 20
#: What Spark has to be told before it offers filters to connectors in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _plain(value):
    """A bound as JSON has it: numbers and strings as they are, dates in a form that sorts like they do; None for what has no bounds (times, which zones shift, and others)."""
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, bool) or (isinstance(value, float) and not math.isfinite(value)):
        return None
    return value if isinstance(value, (int, float, str)) else None


class Log:
    """The entries of a table's log, one file each, numbered from 1."""

    def __init__(self, path: str):
        self.fs, self.root = files.FileSystem.from_uri(path)

    def numbers(self) -> list[int]:
        found = self.fs.get_file_info(files.FileSelector(f"{self.root}/_log", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def entry(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/_log/{number:012d}.json") as f:
            return json.loads(f.read())

    def known(self, upto: int | None = None) -> list[dict]:
        """All files of the table as of entry ``upto``."""
        out: list[dict] = []
        for number in reversed([n for n in self.numbers() if upto is None or n <= upto]):
            entry = self.entry(number)
            out = [*entry.get("whole", entry["files"]), *out]
            if "whole" in entry or entry["fresh"]:
                break
        return out

    def append(self, added: list[dict], schema: StructType, fresh: bool, batch: list | None = None) -> None:
        numbers = self.numbers()
        entry = {"files": added, "schema": schema.jsonValue(), "fresh": fresh, "batch": batch}
        number = numbers[-1] + 1 if numbers else 1
        if number % WHOLE_EVERY == 0:
            entry["whole"] = added if fresh else [*self.known(), *added]
        self.fs.create_dir(f"{self.root}/_log")
        # an entry is whole or not there
        made = f"{self.root}/_log/{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(made) as f:
            f.write(json.dumps(entry).encode())
        self.fs.move(made, f"{self.root}/_log/{number:012d}.json")

    def forget(self, names: Iterable[str]) -> None:
        for name in names:
            if self.fs.get_file_info(f"{self.root}/{name}").type != files.FileType.NotFound:
                self.fs.delete_file(f"{self.root}/{name}")


@dataclasses.dataclass
class Written(WriterCommitMessage):
    """What a task wrote."""

    files: list[dict]


@dataclasses.dataclass
class Files(InputPartition):
    """Files that a task reads."""

    names: list[str]

    def __post_init__(self):
        super().__init__(self.names)


def dealt(known: list[dict]) -> list[Files]:
    """Files of one task after another, of about :data:`TASK_BYTES`."""
    out: list[Files] = []
    room = 0
    for f in sorted(known, key=lambda f: -f["bytes"]):
        if room < f["bytes"]:
            out.append(Files([]))
            room = TASK_BYTES
        out[-1].names.append(f["name"])
        room -= f["bytes"]
    return out


def may_hold(file: dict, wanted: Filter) -> bool:
    """Whether a file can have rows that a filter lets pass; what isn't known may be."""
    attribute = getattr(wanted, "attribute", None)
    if not attribute or len(attribute) != 1 or attribute[0] not in file["bounds"]:
        return True
    low, high = file["bounds"][attribute[0]]
    if low is None:
        # nothing but nulls, which no comparison lets pass
        return not isinstance(wanted, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In))
    values = [_plain(v) for v in (wanted.value if isinstance(wanted, In) else [getattr(wanted, "value", None)])]
    if any(v is None or isinstance(v, str) != isinstance(low, str) for v in values):
        return True
    if isinstance(wanted, (EqualTo, In)):
        return any(low <= v <= high for v in values)
    tests = {GreaterThan: lambda v: high > v, GreaterThanOrEqual: lambda v: high >= v, LessThan: lambda v: low < v, LessThanOrEqual: lambda v: low <= v}
    return tests[type(wanted)](values[0]) if type(wanted) in tests else True


def batches_of(path: str, part: Files) -> Iterator[pa.RecordBatch]:
    log = Log(path)
    for name in part.names:
        with log.fs.open_input_file(f"{log.root}/{name}") as f:
            yield from pq.ParquetFile(f).iter_batches()


class LedgerReader(DataSourceReader):
    def __init__(self, path: str, pruned: bool):
        self.path, self.pruned, self.filters = path, pruned, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps filters for choosing files, where :func:`read` asks for it; Spark applies all of them to rows as well."""
        if self.pruned:
            self.filters = filters
        return filters

    def partitions(self) -> list[InputPartition]:
        return dealt([f for f in Log(self.path).known() if all(may_hold(f, wanted) for wanted in self.filters)])

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return batches_of(self.path, partition) if partition is not None else iter(())


class LedgerStreamReader(DataSourceStreamReader):
    """Reads what commits add, from the first on; a commit that replaces the table ends the stream with an error."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        return {"entry": (Log(self.path).numbers() or [0])[-1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = Log(self.path)
        found = [log.entry(n) for n in log.numbers() if start["entry"] < n <= end["entry"]]
        if start["entry"] and any(e["fresh"] for e in found):
            raise RuntimeError("the table was replaced while a stream read it")
        return dealt([f for e in found for f in e["files"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches_of(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class _Writer:
    """Writes each task's rows to a file of its own and, when all are there, names them in the log."""

    def __init__(self, path: str, schema: StructType, fresh: bool, run: str | None = None):
        self.path, self.schema, self.fresh, self.run = path, schema, fresh, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        log, name, schema = Log(self.path), f"{uuid.uuid4().hex}.parquet", to_arrow_schema(self.schema)
        rows, bounds, writer = 0, {}, None
        log.fs.create_dir(log.root)
        try:
            with log.fs.open_output_stream(f"{log.root}/{name}") as f:
                writer = pq.ParquetWriter(f, schema)
                for batch in iterator:
                    table = pa.Table.from_batches([batch]).cast(schema)
                    writer.write_table(table)
                    rows += table.num_rows
                    self._widen(bounds, table)
                writer.close()
        except BaseException:
            log.forget([name])
            raise
        if not rows:
            log.forget([name])
            return Written([])
        own = {c: b for c, b in bounds.items() if b is not False}
        return Written([{"name": name, "rows": rows, "bytes": log.fs.get_file_info(f"{log.root}/{name}").size, "bounds": own}])

    @staticmethod
    def _widen(bounds: dict, table: pa.Table) -> None:
        for name in table.column_names:
            column = table.column(name)
            if pa.types.is_nested(column.type) or pa.types.is_boolean(column.type) or pa.types.is_null(column.type) or bounds.get(name) is False:
                bounds[name] = False
                continue
            if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
                # above all numbers for Spark, and no bound
                bounds[name] = False
                continue
            found = pc.min_max(column).as_py()
            if found["min"] is None:
                bounds.setdefault(name, [None, None])
                continue
            low, high = _plain(found["min"]), _plain(found["max"])
            if low is None or high is None:
                bounds[name] = False
            else:
                old = bounds.get(name, [None, None])
                bounds[name] = [low, high] if old[0] is None else [min(low, old[0]), max(high, old[1])]

    def _commit(self, messages: list[Written | None], batch: list | None = None) -> None:
        Log(self.path).append([f for m in messages if m is not None for f in m.files], self.schema, self.fresh, batch)

    def _abort(self, messages: list[Written | None]) -> None:
        Log(self.path).forget(f["name"] for m in messages if m is not None for f in m.files)


class LedgerWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class LedgerStreamWriter(_Writer, DataSourceStreamArrowWriter):
    """As the writer of batches; a batch that the log has already, by the stream's name and number, isn't added again."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        log = Log(self.path)
        if any(log.entry(n)["batch"] == [self.run, batchId] for n in reversed(log.numbers()[-WHOLE_EVERY:])):
            self._abort(messages)
        else:
            self._commit(messages, [self.run, batchId])

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


class Ledger(DataSource):
    """The format ``ledger``; ``path`` names the folder. Streams that write give themselves a ``name`` that stays the same when they start again."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> StructType:
        log = Log(self.options["path"])
        numbers = log.numbers()
        if not numbers:
            raise ValueError(f"no table at {self.options['path']}")
        return StructType.fromJson(log.entry(numbers[-1])["schema"])

    def reader(self, schema: StructType) -> LedgerReader:
        return LedgerReader(self.options["path"], self.options.get("pruned") == "true")

    def streamReader(self, schema: StructType) -> LedgerStreamReader:
        return LedgerStreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> LedgerWriter:
        return LedgerWriter(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> LedgerStreamWriter:
        return LedgerStreamWriter(self.options["path"], schema, False, self.options.get("name", ""))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and have filters offered to it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Ledger)


#: How conditions of :func:`read` compare.
COMPARED = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def read(spark: SparkSession, path: str, *conditions: tuple[str, str, object]) -> DataFrame:
    """The rows for which all ``conditions`` hold, such as ``("price", ">", 100.0)``; files that can't have any aren't opened.

    A frame keeps to the commits that it saw first. Files are chosen by filters for frames made here alone: Spark 4.1 hands the filters that it
    has given to a connector in Python to later queries of the same frame that have none that it could
    give. Each query of such a frame has its conditions, so it always gives some.
    """
    plain = spark.read.format("ledger")
    if not conditions:
        return plain.load(path)
    found = plain.option("pruned", "true").load(path)
    for column, compared, value in conditions:
        found = found.where(COMPARED[compared](F.col(f"`{column}`"), F.lit(value)))
    return found
