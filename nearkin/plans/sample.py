"""A sample library in tables: moments of several frames, single photos, and a file that cannot be decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions import scenes
from nearkin.functions.exif import PARTS
from nearkin.runtime import cut
from nearkin.sources.images import photos_from_rasters

#: Months and days of the moments; single photos are of one month.
DAYS = ((3, 14), (3, 15), (5, 2), (7, 21), (9, 8), (12, 24))
YEAR, SINGLE_MONTH, NOISE = 2026, 8, 6


def frames() -> list[tuple]:
    """(path, seed, frame, soft, month, day): frame 0 is the scene itself."""
    out, seed = [], 1
    for m, ((count, soft), (month, day)) in enumerate(zip(scenes.MOMENTS, DAYS, strict=True)):
        out += [(f"moment {m + 1}/IMG_{seed:02d}{k:02d}.jpg", seed, k, soft and k == count - 1, month, day) for k in range(count)]
        seed += 1
    return out + [(f"single/IMG_{seed + k:02d}00.jpg", seed + k, 0, False, SINGLE_MONTH, 1 + k) for k in range(scenes.SINGLES)]


def sample_library(spark: SparkSession, root: str = "/sample", width: int = 240, height: int = 180) -> DataFrame:
    """The photos of the library, with features; further frames are shifted, noisy and maybe out of focus."""
    named = spark.createDataFrame(frames(), "name string, seed long, frame int, soft boolean, month int, day int").repartition(8)
    rows = named.withColumn("path", F.concat(F.lit(root + "/"), "name"))
    # each picture is a column of a table that is cut, so that none is made again for every pixel of the next
    plain = rows.withColumn("base", scenes.textured(width, height, F.col("seed")))
    own = F.col("seed") * 40503 + F.col("frame") * 7
    step = lambda k: (F.shiftright(scenes.lcg(own, F.lit(k).cast("long"), 2), 16) % 3 - 1).cast("int")
    moved = cut(plain).withColumn("moved", scenes.shifted(F.col("base"), width, height, step(1), step(2)))
    rough = cut(moved).withColumn("rough", scenes.noisy(F.col("moved"), width * height, NOISE, own + 1))
    rough = cut(rough)
    soft = scenes.blurred(F.col("rough"), width, height)
    pixels = F.when(F.col("frame") == 0, F.col("base")).when(F.col("soft"), soft).otherwise(F.col("rough"))
    parts = dict(zip(PARTS, (F.lit(YEAR), F.col("month"), F.col("day"), F.lit(12), F.col("frame"), F.lit(0)), strict=True))
    rasters = rough.select("path", F.lit(width).alias("width"), F.lit(height).alias("height"), pixels.alias("pixels"), F.struct(*[v.cast("int").alias(k) for k, v in parts.items()]).alias("date"),
                           F.lit(None).cast("int").alias("full_width"), F.lit(None).cast("int").alias("full_height"))
    broken = spark.createDataFrame([(f"{root}/broken.jpg",)], "path string")
    places = {p: i for i, p in enumerate(sorted([f"{root}/{f[0]}" for f in frames()] + [f"{root}/broken.jpg"]))}
    paths = rows.select("path").union(broken).join(F.broadcast(spark.createDataFrame(list(places.items()), "path string, photo_idx long")), "path")
    return photos_from_rasters(paths.select("photo_idx", "path", F.lit(width * height).cast("long").alias("file_size")), rasters)
