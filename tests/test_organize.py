"""Numbers of names by arithmetic, against taking them one by one."""

import random

import pytest
from pyspark.sql import functions as F
from test_groups import JULY, organise_brute, plan_of, rows_of

from nearkin.operators import organize


def strict_brute(photos, root, occupied):
    return organise_brute([(f"elsewhere/{p}", d) for p, d in photos], root, occupied)


@pytest.mark.parametrize("size", [1, 5, 8192])
@pytest.mark.parametrize("strict", [False, True])
def test_gaps_brute_force(spark, monkeypatch, size, strict):
    """Names that meet no other name; ranges of any size give the same numbers."""
    monkeypatch.setattr(organize, "RANGE", size)
    rng = random.Random(size)
    names = ["a.jpg", "b.tar.gz", "c", ".d", "e (x).png", "f (02).jpg", "g (1).jpg", "(2).jpg", "h (2)x.jpg", "a (200).jpg"]
    photos = [(f"{rng.choice(['x', 'r/Undated', 'r/2026/2026-07'])}/{rng.choice(names)}", rng.choice([None, JULY])) for _ in range(150)]
    occupied = {p for p, _ in photos if p.startswith("r/") and rng.random() < 0.5}
    for folder in ("r/Undated", "r/2026/2026-07", "other"):
        for name in names:
            dot = name.rfind(".")
            head, tail = (name[:dot], name[dot:]) if dot > 0 else (name, "")
            occupied |= {f"{folder}/{head} ({k}){tail}" for k in (1, 3, 4, 9, 10, 11, 99, 10**17) if rng.random() < 0.8}
            occupied |= {f"{folder}/{head} (05){tail}", f"{folder}/{head} (123456789012345678901234567890){tail}", f"{folder}/{head}(2){tail}", f"{folder}/\\{head} (2){tail}"}
    occupied |= {"no folder (2).jpg", "r/Undated/ (2).jpg"}
    plan = plan_of(spark, photos, "r", sorted(occupied), strict=strict)
    assert [d for d, _, _ in rows_of(plan)] == (strict_brute if strict else organise_brute)(photos, "r", occupied)


@pytest.mark.parametrize("seed", [1, 2])
def test_names_that_may_meet(spark, monkeypatch, seed):
    """Whether a family is read as a stream or by arithmetic, each photo gets what it would get one by one."""
    monkeypatch.setattr(organize, "RANGE", 3)
    rng = random.Random(seed)
    names = ["a.jpg"] * 3 + [f"a ({k}).jpg" for k in (2, 3, 7, 12, 13, 40)] + ["a (2) (2).jpg", "a (40) (2).jpg", "b.png", "b (30).png"]
    photos = [(f"{rng.choice(['x', 'y', 'r/Undated'])}/{rng.choice(names)}", None if rng.random() < 0.7 else JULY) for _ in range(40)]
    occupied = {f"r/Undated/{n}" for n in names if rng.random() < 0.3} | {f"r/2026/2026-07/b ({k}).png" for k in range(2, 30, 3)}
    assert [d for d, _, _ in rows_of(plan_of(spark, photos, "r", sorted(occupied)))] == organise_brute(photos, "r", occupied)


def test_hot_name_is_dealt(spark):
    """200,000 photos of one occupied name: no Python, and no task has them all."""
    n = 200_000
    photos = spark.range(n).select(F.col("id").alias("photo_idx"), F.lit("dump/hot.jpg").alias("path"), F.lit(None).cast("struct<year:int,month:int,day:int,hour:int,minute:int,second:int>").alias("date"))
    occupied = spark.range(1, 50_000, 3).select(F.format_string("r/Undated/hot (%d).jpg", "id").alias("path")).union(spark.createDataFrame([("r/Undated/hot.jpg",)], "path string"))
    plan = organize.organise_plan(photos, photos.select(F.col("photo_idx").alias("pos"), "photo_idx"), "r", occupied)
    assert "Python" not in plan._jdf.queryExecution().toString() and "Pandas" not in plan._jdf.queryExecution().toString()
    # the tasks that number the photos
    before, keep = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = plan.select("pos", F.regexp_extract("destination", r"\((\d+)\)", 1).cast("long").alias("k"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    free = [k for k in range(2, n + 50_000) if k % 3 != 1 or k >= 50_000][:n]
    assert [r["k"] for r in sorted(rows)] == free
    sizes = {}
    for r in rows:
        sizes[r["task"]] = sizes.get(r["task"], 0) + 1
    assert len(sizes) >= 12 and max(sizes.values()) <= 50_000


def test_occupied_names_need_no_plan(spark, monkeypatch):
    from nearkin import queries

    def none(*args):
        raise AssertionError("a plan was made")

    monkeypatch.setattr(queries, "plan", none)
    found = queries.QUERIES["organize_occupied"](spark, "/root/testdata/sf0.001").agg(F.count(F.lit(1)), F.min("number")).first()
    assert found[0] > 0 and found[1] == 2
