"""The scan of a library: photos, groups, keepers, marks and counts, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions.bits import DEFAULT_THRESHOLD
from nearkin.functions.paths import summary_text
from nearkin.operators import keeper, neardup
from nearkin.runtime import cut

#: Tight, default and loose thresholds; progress reports of a scan.
PRESETS = {"tight": 1, "default": 3, "loose": 5}
PROGRESS_STEPS = 200


@dataclass
class ScanResult:
    """photos (with failures), memberships (group_id, idx), stats (comparisons, naive_comparisons), which are counted when asked for."""

    photos: DataFrame
    memberships: DataFrame
    counted: Callable[[], DataFrame]

    @cached_property
    def stats(self) -> DataFrame:
        return self.counted()

    def scores(self) -> DataFrame:
        return self.photos.select(F.col("photo_idx").alias("idx"), "sharpness", "width", "height")

    def keepers(self) -> DataFrame:
        return keeper.keepers(self.memberships, self.scores())

    def removal_marks(self) -> DataFrame:
        return keeper.removal_marks(self.memberships, self.keepers())

    def summary(self, marked: DataFrame | None = None) -> DataFrame:
        """One row of counts and the summary text; without ``marked`` all members but keepers count as ticked."""
        photos = self.photos.agg(F.count(F.lit(1)).alias("photos"), F.count_if(~F.col("decoded")).alias("failed"))
        sizes = self.memberships.groupBy("group_id").count().agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("in_groups"))
        ticked = (sizes.select((F.col("in_groups") - F.col("groups")).alias("marked")) if marked is None else marked.agg(F.count(F.lit(1)).alias("marked")))
        # one row each
        row = photos.crossJoin(sizes).crossJoin(ticked).crossJoin(self.stats)
        text = summary_text(*[F.col(c) for c in ("photos", "failed", "groups", "in_groups", "marked", "comparisons", "naive_comparisons")])
        return row.withColumn("summary", text)


def scan_photos(photos: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> ScanResult:
    """Group photos that have features: (photo_idx, path, hash, sharpness, width, height, decoded, ...)."""
    photos = cut(photos)
    hashes = photos.filter("decoded").select(F.col("photo_idx").alias("idx"), "hash")
    return ScanResult(photos, cut(neardup.near_groups(hashes, threshold)), lambda: neardup.candidate_stats(hashes))


def scan_library(spark: SparkSession, root: str, threshold: int = DEFAULT_THRESHOLD) -> ScanResult:
    """Find, decode and group the photos below ``root``. Cancel it as any Spark job, by its tag."""
    from nearkin.sources.images import decoded_photos, find_photos

    if not root:
        raise ValueError("no folder given")
    return scan_photos(decoded_photos(spark, find_photos(spark, root), root), threshold)


def progress_due(done: int, total: int) -> bool:
    """Whether a report is due after ``done`` of ``total`` photos: about 200 times, and at the end."""
    return done == total or done % max(1, total // PROGRESS_STEPS) == 0


#: Tags of scans that run now; a second scan with one of them is refused.
_running: set[str] = set()


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that start within carry ``tag``; ``cancel`` stops them from another thread. A scan whose
    tag still runs raises a ValueError."""
    if tag in _running:
        raise ValueError(f"a scan with the tag {tag!r} is running")
    _running.add(tag)
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)
        _running.discard(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the running jobs with a tag; their scan fails and gives no result."""
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession) -> tuple[int, int]:
    """(done, total) tasks of the stages that run now, for a poller."""
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
    return sum(i.numCompletedTasks for i in infos if i), sum(i.numTasks for i in infos if i)
