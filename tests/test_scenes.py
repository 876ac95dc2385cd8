"""Scenes and Exif writing as expressions, against arrays and the reader."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import blurred, brighter, noisy, scene

from nearkin.functions import exif, exif_writer, scenes
from nearkin.functions.exif_writer import Entry
from nearkin.plans import library, sample

W, H = 40, 30


def pixels_of(df):
    return {r[0]: np.array(r[1], np.uint8).reshape(H, W) for r in df.collect()}


def test_scenes_and_variations(spark):
    rows = spark.range(4).select("id", scenes.scene(W, H, F.col("id").cast("int")).alias("p"))
    got = pixels_of(rows)
    for k in range(4):
        assert (got[k] == scene(W, H, k)).all()
    assert all((v == brighter(scene(W, H, k), 30)).all() for k, v in pixels_of(rows.select("id", scenes.brighter(F.col("p"), 30))).items())
    noise = rows.select("id", scenes.noisy(F.col("p"), W * H, 12, F.col("id") * 1_000_003_003 + 7).alias("p"))
    want = {k: noisy(scene(W, H, k), 12, (k * 1_000_003_003 + 7) & 0xFFFFFFFF) for k in range(4)}
    assert all((v == want[k]).all() for k, v in pixels_of(noise).items())
    assert all((v == blurred(want[k], 1)).all() for k, v in pixels_of(noise.select("id", scenes.blurred(F.col("p"), W, H))).items())
    moved = pixels_of(rows.select("id", scenes.shifted(F.col("p"), W, H, F.lit(2), F.lit(-3))))
    want = np.zeros((H, W), np.uint8)
    want[:-3, 2:] = scene(W, H, 1)[3:, :-2]
    assert (moved[1] == want).all()


def test_jumping_ahead(spark):
    steps = [0, 1, 2, 3, 31, 32, 1000, 607_500]
    rows = spark.createDataFrame([(s, n) for s in (0, 1, 0xFFFFFFFF) for n in steps], "seed long, n long")
    got = {(r[0], r[1]): r[2] for r in rows.select("seed", "n", scenes.lcg(F.col("seed"), F.col("n"), max(steps))).collect()}
    for seed in (0, 1, 0xFFFFFFFF):
        state = seed
        for n in range(max(steps) + 1):
            if n in steps:
                assert got[seed, n] == state
            state = (state * 1664525 + 1013904223) & 0xFFFFFFFF


def test_sample_library(spark):
    """28 files: six moments of 19 frames, eight single photos and one that cannot be decoded."""
    result = library.scan_photos(sample.sample_library(spark))
    row = result.summary().first()
    assert (row["photos"], row["failed"], row["groups"], row["in_groups"]) == (28, 1, 6, 19)
    folders = {r["photo_idx"]: r["path"].split("/")[2] for r in result.photos.collect()}
    groups = {}
    for r in result.memberships.collect():
        groups.setdefault(r["group_id"], []).append(folders[r["idx"]])
    assert sorted((g[0], len(g)) for g in groups.values()) == [(f"moment {m + 1}", n) for m, (n, _) in enumerate(scenes.MOMENTS)]
    assert all(len(set(g)) == 1 for g in groups.values())


@pytest.mark.parametrize("little", [True, False])
def test_written_tags_are_read(spark, little):
    texts = ["", "a", "abc", "abcd", "abcde", "é" * 9, "x" * 300, None, "y" * 70_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    date = F.lit("2026:07:14 18:05:30")
    main = [Entry(exif.TAG_ORIENTATION, exif_writer.SHORT, F.col("i") % 8 + 1), Entry(0x010F, exif_writer.ASCII, F.col("t")), Entry(0x0101, exif_writer.LONG, F.lit(70_000)), Entry(exif.TAG_DATETIME, exif_writer.ASCII, F.lit("2020:01:02 03:04:05"))]
    whole = exif_writer.exif_jpeg(main, [Entry(exif.TAG_DIGITIZED, exif_writer.ASCII, F.col("t")), Entry(exif.TAG_ORIGINAL, exif_writer.ASCII, date)], little)
    for r in rows.select("i", "t", whole.alias("both"), exif_writer.exif_jpeg(main, little=little).alias("main"), exif_writer.exif_jpeg(main[:1], little=little).alias("turn")).collect():
        assert exif.read_orientation(bytes(r["turn"])) == r["i"] % 8 + 1 and exif.read_date(bytes(r["turn"])) is None
        if r["t"] is None or len(r["t"]) > 60_000:
            assert r["both"] is None and r["main"] is None
            continue
        assert exif.read_date(bytes(r["both"])) == (2026, 7, 14, 18, 5, 30) and exif.read_orientation(bytes(r["both"])) == r["i"] % 8 + 1
        assert exif.read_date(bytes(r["main"])) == (2020, 1, 2, 3, 4, 5) and exif.read_orientation(bytes(r["main"])) == r["i"] % 8 + 1
        tiff, first = exif._tiff(exif._exif_block(bytes(r["both"])))
        found = {tag: (kind, count, at) for tag, kind, count, at in tiff.entries(first)}
        kind, count, at = found[0x010F]
        data = r["t"].encode() + b"\0"
        start = at if count <= 4 else tiff.number(at, 4)
        assert (kind, count, tiff.data[start : start + count]) == (2, len(data), data) and tiff.number(found[0x0101][2], 4) == 70_000
        assert list(found) == sorted(found)


def test_the_constant_heads_of_the_rows(spark):
    from nearkin.queries import BIG, LITTLE

    date = F.lit("2026:07:14 18:05:30")
    for head, little in ((LITTLE, True), (BIG, False)):
        got = spark.range(1).select(F.hex(exif_writer.exif_jpeg([], [Entry(exif.TAG_ORIGINAL if little else exif.TAG_DIGITIZED, exif_writer.ASCII, date)], little))).first()[0]
        assert got.startswith(("FFD8FFE1", head[:8])[0]) and exif.read_date(bytes.fromhex(got)) == (2026, 7, 14, 18, 5, 30)
