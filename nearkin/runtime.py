"""Session settings and the shared folder that long plans are cut at."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(master)
        .appName("nearkin")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Most bytes of rows in one batch for a Python worker, so that long rows do not add up.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per context, so that their Python workers can import
    it; bound the batches that workers get, unless the session bounds them more tightly."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_nearkin_shipped", None) is None:
        top = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="nearkin-")) / "nearkin.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(top.rglob("*.py")):
                z.write(file, file.relative_to(top.parent))
        context.addPyFile(str(archive))
        context._nearkin_shipped = str(archive)
    return spark


def _bytes(value: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = value.lower().rstrip("b")
    return int(number[:-1]) * units[number[-1]] if number and number[-1] in units else int(number)


#: Tables below this many bytes may be dealt anew after the scan.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table as read, with its rows dealt to all cores if it has fewer files than there are
    cores: the rows of a Parquet row group are read by one task. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < SPREAD_BYTES and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session names none on a single machine, as in tests, a folder of its own is set; on a
    cluster that is an error, as executors cannot share a machine's own folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="nearkin-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut.

    The copy outlives executors; Spark deletes it when the DataFrame is no longer referenced.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which the shuffle files of an action go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions on DataFrames made within it leave no shuffle files, which else stay until the driver happens to collect
    its garbage: for many rounds that are cut. A DataFrame that is given out is to be made after it, as an action on it may be repeated."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of this call's own in the shared folder; not yet created."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (cut, so that counting is cheap) marked for a broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
