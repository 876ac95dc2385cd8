"""Places of rows in an order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.runtime import cut


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0; rows that are equal in it come in any order.

    Rows are dealt by ranges and sorted; a row's place is that within its range plus the rows of
    earlier ranges, of which the driver sees a count for each.
    """
    # the upper bits of the number are the range, the lower 33 the place within it
    dealt = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted(dealt.groupBy(F.shiftright("_at", 33).alias("range")).count().collect())
    starts, before = [], 0
    for r in counts:
        starts.append((r["range"], before))
        before += r["count"]
    # one row for each range that is not empty
    ranges = F.broadcast(df.sparkSession.createDataFrame(starts, "_range long, _before long"))
    out = dealt.withColumn("_range", F.shiftright("_at", 33)).join(ranges, "_range")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_range", "_before")
