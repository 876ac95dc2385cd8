"""Which member of a group stays, and what follows from removals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keepers(members: DataFrame, scores: DataFrame) -> DataFrame:
    """(group_id, keeper): the sharpest member, then the largest area, then the earliest.

    ``scores``: (idx, sharpness, width, height). A maximum per group, with partial aggregation.
    """
    area = F.col("width").cast("double") * F.col("height")
    rank = F.struct("sharpness", area.alias("area"), (-F.col("idx")).alias("back"))
    return members.join(scores, "idx").groupBy("group_id").agg((-F.max(rank)["back"]).alias("keeper"))


def removal_marks(members: DataFrame, best: DataFrame) -> DataFrame:
    """(group_id, idx): every member but the keeper."""
    return members.join(best, "group_id").filter("idx <> keeper").select("group_id", "idx")


def regroup(members: DataFrame, removed: DataFrame) -> DataFrame:
    """(group_id, idx) after a removal: groups that keep fewer than two members go; group_id is again the smallest member."""
    left = members.join(removed.select("idx"), "idx", "left_anti")
    groups = left.groupBy("group_id").agg(F.min("idx").alias("new_id"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return left.join(groups, "group_id").select(F.col("new_id").alias("group_id"), "idx")


def group_sizes(members: DataFrame) -> DataFrame:
    """(group_id, size, to_remove)."""
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).withColumn("to_remove", F.col("size") - 1)
