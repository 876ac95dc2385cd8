"""Photo files: listing, decoding to gray rasters, and a source held in memory.

``find_photos`` lists with Spark's file index, so it reads any store that Spark reads; names that
start with a dot or an underscore are hidden to it. ``find_local_photos`` walks a local folder and
keeps those names. Pixels come from Spark's image source (one decoder for all formats that the
JVM reads), bytes for the capture time from the binary source.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from nearkin.functions.exif import DATE_TYPE, PARTS, PREFIX_BYTES, read_date, read_orientation
from nearkin.functions.paths import PHOTO_EXTENSIONS, has_photo_extension
from nearkin.functions.raster import np_box_downscale, np_difference_hash, np_laplacian_variance
from nearkin.operators.ranks import numbered

#: The longest side that is hashed, and that of a thumbnail.
WORKING_SIDE, THUMBNAIL_SIDE = 256, 132
FEATURES = f"path string, file_size long, hash long, sharpness double, date {DATE_TYPE}, width int, height int, decoded boolean"

#: A decoder takes (path, bytes) and gives (gray 2-D array, original width, original height), or None.
Decoder = Callable[[str, bytes], tuple[np.ndarray, int, int] | None]


def _numbered(paths: DataFrame) -> DataFrame:
    """With photo_idx, the place in path order from 0."""
    return numbered(paths, F.col("path").asc(), "photo_idx")


def find_photos(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_size, photo_idx) of the photo files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _numbered(files.filter(has_photo_extension(F.col("path"))).select("path", F.col("length").alias("file_size")))


def find_local_photos(spark: SparkSession, root: str) -> DataFrame:
    """As ``find_photos`` for a folder of this machine: hidden names are kept, folders that cannot be
    read are skipped, links to folders are not followed, an unreadable root gives no photo."""
    found = []
    for folder, _, names in os.walk(root, followlinks=False):
        for name in names:
            path = os.path.join(folder, name)
            if name.lower().endswith(tuple("." + e for e in PHOTO_EXTENSIONS)) and os.path.isfile(path):
                found.append((path, os.path.getsize(path)))
    return _numbered(spark.createDataFrame(sorted(found), "path string, file_size long"))


def to_gray(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Luma of the image source's bytes (blue, green, red, maybe alpha): (11R + 16G + 5B) div 32."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0]
    b, g, r = (pixels[:, :, i].astype(np.uint16) for i in range(3))
    return ((11 * r + 16 * g + 5 * b) // 32).astype(np.uint8)


def fit(gray: np.ndarray, side: int = WORKING_SIDE) -> np.ndarray:
    """Box-reduced so that no side is longer than ``side``; never enlarged."""
    h, w = gray.shape
    if max(h, w) <= side:
        return gray
    scale = side / max(h, w)
    return np_box_downscale(gray, max(1, round(w * scale)), max(1, round(h * scale)))


def thumbnail(gray: np.ndarray, side: int = THUMBNAIL_SIDE) -> np.ndarray:
    """Scaled so that the longest side is ``side``; small images are enlarged."""
    h, w = gray.shape
    scale = side / max(h, w)
    return np_box_downscale(gray, max(1, round(w * scale)), max(1, round(h * scale)))


def upright(gray: np.ndarray, orientation: int) -> np.ndarray:
    """Turned and mirrored as the orientation tag says."""
    turned = {1: gray, 2: gray[:, ::-1], 3: gray[::-1, ::-1], 4: gray[::-1], 5: gray.T, 6: gray.T[:, ::-1], 7: gray.T[::-1, ::-1], 8: gray.T[::-1]}
    return np.ascontiguousarray(turned[orientation])


def oriented_hashes(gray: np.ndarray) -> list[int]:
    """The difference hash under each orientation tag, 1 to 8."""
    return [np_difference_hash(upright(gray, k)) for k in range(1, 9)]


@F.pandas_udf(StructType([StructField(k, IntegerType()) for k in ("orientation", *PARTS)]))
def _tags(head: pd.Series) -> pd.DataFrame:
    rows = [(read_orientation(bytes(x)), *(read_date(bytes(x)) or (None,) * len(PARTS))) for x in head]
    return pd.DataFrame(rows, columns=["orientation", *PARTS], dtype="Int32")


def decoded_photos(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """The features of each listed file below ``root``; a file that cannot be decoded has decoded=false.

    Sizes are those stored in the file. Pixels are decoded and reduced where they are read, one image
    at a time, and never shuffled: an image leaves its sharpness, which no orientation changes, and
    its hash under each orientation, and the tag, read from the file's bytes, picks one in a thin join.
    """
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    images = images.filter(has_photo_extension(F.col("image.origin"))).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.width > 0 and r.height > 0:
                    gray = fit(to_gray(bytes(r.data), r.width, r.height, r.nChannels))
                    rows.append((unquote(r.origin), int(r.width), int(r.height), oriented_hashes(gray), np_laplacian_variance(gray), True))
                else:
                    rows.append((unquote(r.origin), 0, 0, [0] * 8, 0.0, False))
            yield pd.DataFrame(rows, columns=["origin", "width", "height", "hashes", "sharpness", "decoded"])

    seen = images.mapInPandas(reduce, "origin string, width int, height int, hashes array<long>, sharpness double, decoded boolean")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(has_photo_extension(F.col("path")))
    tags = files.select(F.col("path").alias("file"), _tags(F.substring("content", 1, PREFIX_BYTES)).alias("tags"))
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")  # noqa: E731  the two sources write schemes in different ways
    found = seen.join(tags, bare(F.col("origin")) == bare(F.col("file")))
    out = paths.join(found, bare(F.col("path")) == bare(F.col("file")), "left")
    ok = F.coalesce("decoded", F.lit(False))
    date = F.struct(*[F.col(f"tags.{k}").alias(k) for k in PARTS])
    return out.select(
        "photo_idx", "path", "file_size", F.when(ok, F.element_at("hashes", F.col("tags.orientation"))).otherwise(0).alias("hash"), F.when(ok, F.col("sharpness")).otherwise(0.0).alias("sharpness"),
        F.when(ok & F.col("tags.year").isNotNull(), date).alias("date"), F.when(ok, F.col("width")).otherwise(0).alias("width"), F.when(ok, F.col("height")).otherwise(0).alias("height"), ok.alias("decoded"))


def thumbnails(photos: DataFrame, content: DataFrame, decoder: Decoder, side: int = THUMBNAIL_SIDE) -> DataFrame:
    """(photo_idx, width, height, pixels): a gray thumbnail of each photo that ``decoder`` can read.
    ``content``: (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if (found := decoder(r.path, bytes(r.content))) is not None:
                    small = thumbnail(found[0], side)
                    rows.append((r.photo_idx, small.shape[1], small.shape[0], small.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["photo_idx", "width", "height", "pixels"])

    both = photos.select("photo_idx", "path").join(content.filter("content IS NOT NULL").select("path", "content"), "path")
    return both.select("photo_idx", "path", "content").mapInPandas(run, "photo_idx long, width int, height int, pixels binary")


def photos_with(paths: DataFrame, content: DataFrame, decoder: Decoder) -> DataFrame:
    """As ``decoded_photos`` with a decoder of one's own; ``content``: (path, content). Contents are joined and read once:
    what is decoded and the capture time come from the same pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                data = None if r.content is None else bytes(r.content)
                found = None if data is None else decoder(r.path, data)
                if found is None:
                    rows.append((r.photo_idx, r.path, r.file_size, 0, 0.0, None, 0, 0, False))
                else:
                    gray, width, height = found
                    date = read_date(data[:PREFIX_BYTES])
                    rows.append((r.photo_idx, r.path, r.file_size, np_difference_hash(gray), np_laplacian_variance(gray), date and dict(zip(PARTS, date, strict=True)), width, height, True))
            yield pd.DataFrame(rows, columns=["photo_idx", *[x.split()[0] for x in FEATURES.replace(", ", "\n").splitlines()]])

    both = paths.join(content.select("path", "content"), "path", "left")
    return both.select("photo_idx", "path", "file_size", "content").mapInPandas(run, f"photo_idx long, {FEATURES}")


def photos_from_rasters(paths: DataFrame, rasters: DataFrame) -> DataFrame:
    """As ``decoded_photos`` from rasters held in a table; a path without a raster is a failure.

    ``rasters``: (path, width, height, pixels array<int>, date, and full_width, full_height or null).
    """
    from nearkin.functions.raster import difference_hash, laplacian_variance

    out = paths.join(rasters, "path", "left")
    ok = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.size("pixels") == F.col("width") * F.col("height")), F.lit(False))
    return out.select(
        "photo_idx", "path", "file_size", F.when(ok, difference_hash("pixels", "width", "height")).otherwise(0).alias("hash"),
        F.when(ok, laplacian_variance("pixels", "width", "height")).otherwise(0.0).alias("sharpness"), F.when(ok, F.col("date")).alias("date"),
        F.when(ok, F.coalesce("full_width", "width")).otherwise(0).alias("width"), F.when(ok, F.coalesce("full_height", "height")).otherwise(0).alias("height"), ok.alias("decoded"))
