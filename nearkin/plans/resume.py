"""Scans that can be cancelled and taken up again.

Photos are decoded in batches of their places in path order; one job takes as many batches at a time as keep the jobs of a scan at
about two hundred (``steps``), so their number does not grow with the library. What a job takes is written to a folder of its own below
the scan's folder, and only then named in the manifest, so a batch counts as a whole or not at all, whatever is lost
or cancelled meanwhile. A scan leaves out what the manifest's batches hold (by path and size, so a file that has
changed is read again), and groups are made when nothing is left. A cancelled scan keeps its decoded photos,
without groups and counts.

The driver sees the names of batches and their counts, which come with the write (an observation), not from
a second reading.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearkin.functions.bits import DEFAULT_THRESHOLD
from nearkin.plans.library import PROGRESS_STEPS, ScanResult, progress_due, scan_photos
from nearkin.runtime import cut
from nearkin.sources.images import FEATURES

#: Photos of one batch, by default.
BATCH = 10_000
MANIFEST = "name string, photos long, failed long"
SEEN = f"photo_idx long, {FEATURES}"
COLUMNS = [x.split()[0] for x in SEEN.replace(", ", "\n").splitlines()]


@dataclass(frozen=True)
class Progress:
    """Photos so far: done (with failures), total and failed."""

    done: int
    total: int
    failed: int


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, photos, failed) of the batches that count."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def kept_photos(spark: SparkSession, folder: str) -> DataFrame:
    """The photos of all batches that count."""
    names = [r["name"] for r in manifest(spark, folder).collect()]
    return spark.read.schema(SEEN).parquet(*[f"{folder}/batches/{n}" for n in names]) if names else spark.createDataFrame([], SEEN)


def scan_batches(
    paths: DataFrame, decode: Callable[[DataFrame], DataFrame], folder: str, threshold: int = DEFAULT_THRESHOLD, batch: int = BATCH, steps: int | None = PROGRESS_STEPS,
    cancelled: Callable[[], bool] = lambda: False, on_batch: Callable[[Progress], None] = lambda p: None) -> ScanResult:
    """Scan ``paths`` (photo_idx, path, file_size) into ``folder``, or go on with a scan that is there.

    ``decode`` gives the features of the photos of one job: of a batch, or of several consecutive ones where there are more than
    ``steps`` (None: always of one batch). ``cancelled`` is asked before each job, ``on_batch`` told after each; a job that is cancelled by its tag raises its error, and the batches before it stay.
    A photo that other paths share a place with is none of this scan's concern: places are those of ``paths``.
    """
    spark = paths.sparkSession
    wanted = paths.select("photo_idx", "path", "file_size")
    known = kept_photos(spark, folder).select("path", "file_size").distinct()
    # cut, as every job reads it
    left = cut(wanted.join(known, ["path", "file_size"], "left_anti").withColumn("_batch", F.expr(f"photo_idx div {batch}")))
    if steps is not None:
        first, last = left.agg(F.min("_batch"), F.max("_batch")).first()
        if first is not None:
            left = left.withColumn("_batch", F.expr(f"(_batch - {first}) div {-(-(last - first + 1) // steps)}"))
    # a number for each job
    numbers = sorted(r["_batch"] for r in left.select("_batch").distinct().collect())
    total = wanted.count()
    counts = manifest(spark, folder).agg(F.coalesce(F.sum("photos"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0))).first()
    done, failed = int(counts[0]), int(counts[1])
    for number in numbers:
        if cancelled():
            return cancelled_scan(spark, folder)
        name, seen = uuid.uuid4().hex, Observation()
        photos = decode(left.filter(F.col("_batch") == number).drop("_batch")).select(*COLUMNS)
        observed = photos.observe(seen, F.count(F.lit(1)).alias("photos"), F.count_if(~F.col("decoded")).alias("failed"))
        observed.write.parquet(f"{folder}/batches/{name}")
        found = seen.get
        spark.createDataFrame([(name, found["photos"], found["failed"])], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
        done, failed = done + found["photos"], failed + found["failed"]
        on_batch(Progress(done, total, failed))
    if cancelled():
        return cancelled_scan(spark, folder)
    # places may have changed since a batch was made
    photos = kept_photos(spark, folder).drop("photo_idx").join(wanted, ["path", "file_size"]).select(*COLUMNS)
    return scan_photos(photos, threshold)


def cancelled_scan(spark: SparkSession, folder: str) -> ScanResult:
    """What a cancelled scan keeps: its decoded photos, no groups and no comparisons."""
    none = spark.createDataFrame([(0, 0)], "comparisons long, naive_comparisons long")
    return ScanResult(kept_photos(spark, folder), spark.createDataFrame([], "group_id long, idx long"), lambda: none)


def reports(on_progress: Callable[[Progress], None]) -> Callable[[Progress], None]:
    """An ``on_batch`` that tells ``on_progress`` of about 200 steps and of the end."""
    last = [0]

    def told(now: Progress) -> None:
        if any(progress_due(n, now.total) for n in range(last[0] + 1, now.done + 1)):
            on_progress(now)
        last[0] = now.done

    return told
