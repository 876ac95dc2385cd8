"""What is done to files. A plan is data and is looked at first; nothing here runs unconfirmed.

Effects are made on the driver, a row at a time in plan order, since a later move may need the place
that an earlier one left; rows are streamed, not gathered.
"""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOVED = "source string, destination string, ok boolean"
SHOWN_FAILURES = 10


def apply_moves(plan: DataFrame, confirm: bool = False) -> DataFrame:
    """Move the files of a plan (its rows with action move); gives (source, destination, ok)."""
    if not confirm:
        raise ValueError("look at the plan, then call with confirm=True")
    done = []
    for r in plan.filter("action = 'move'").orderBy("pos").select("source", "destination").toLocalIterator():
        try:
            os.makedirs(os.path.dirname(r.destination), exist_ok=True)
            if os.path.lexists(r.destination):
                raise FileExistsError(r.destination)
            os.rename(r.source, r.destination)
            done.append((r.source, r.destination, True))
        except OSError:
            done.append((r.source, r.destination, False))
    return plan.sparkSession.createDataFrame(done, MOVED)


def trash_plan(photos: DataFrame, marked: DataFrame, trash: str) -> DataFrame:
    """(photo_idx, source, destination): where removed photos would go; numbered, so names never collide."""
    name = F.concat(F.lit(trash.rstrip("/") + "/"), F.col("photo_idx").cast("string"), F.lit("-"), F.regexp_extract("path", r"([^/\\]*)$", 1))
    return photos.join(marked.select("photo_idx"), "photo_idx", "left_semi").select("photo_idx", F.col("path").alias("source"), name.alias("destination"))


def move_to_trash(plan: DataFrame, confirm: bool = False) -> DataFrame:
    """Move the files of a trash plan; nothing is deleted. Gives (photo_idx, source, ok)."""
    if not confirm:
        raise ValueError("look at the plan, then call with confirm=True")
    done = []
    for r in plan.orderBy("photo_idx").toLocalIterator():
        try:
            os.makedirs(os.path.dirname(r.destination), exist_ok=True)
            shutil.move(r.source, r.destination)
            done.append((r.photo_idx, r.source, True))
        except OSError:
            done.append((r.photo_idx, r.source, False))
    return plan.sparkSession.createDataFrame(done, "photo_idx long, source string, ok boolean")


def move_counts(results: DataFrame) -> DataFrame:
    """(moved, failed) of what ``apply_moves`` or ``move_to_trash`` gave."""
    return results.agg(F.count_if("ok").alias("moved"), F.count_if(~F.col("ok")).alias("failed"))


def failure_text(results: DataFrame) -> DataFrame:
    """One row: how many failed, and the first ten names of those, a line each."""
    failed = results.filter("NOT ok")
    first = failed.orderBy("source").limit(SHOWN_FAILURES).agg(F.array_join(F.sort_array(F.collect_list("source")), "\n").alias("names"))
    return failed.agg(F.count(F.lit(1)).alias("failures")).crossJoin(first)
