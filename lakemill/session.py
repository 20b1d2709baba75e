"""Session settings that the engine relies on."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive plans split skewed joins and merge small partitions; times are read as UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "lakemill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with :data:`SETTINGS`; names in ``settings`` have ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch on its way to Python, unless the session says otherwise: texts may be long.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a session, once, so that their Python workers can import it.

    Not needed where it is installed on them or given to ``--py-files``. Bounds the
    bytes of a batch that goes to Python, too, where the session doesn't.
    """
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    made = tempfile.mkdtemp(prefix="lakemill-")
    # executors may ask for it as long as the driver runs
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    archive = Path(made) / "lakemill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"lakemill/{f.relative_to(root)}")
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query whose session gets the package before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
