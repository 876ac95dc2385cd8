"""Scans that are cancelled and taken up again."""

import pytest
from pyspark.sql import functions as F

from nearkin.plans import library, resume
from nearkin.runtime import new_folder

SEEN = "photo_idx long, path string, file_size long, hash long, sharpness double, date struct<year:int,month:int,day:int,hour:int,minute:int,second:int>, width int, height int, decoded boolean"


def listing(spark, n, size=10):
    return spark.range(n).select(F.col("id").alias("photo_idx"), F.format_string("/p/%03d.jpg", "id").alias("path"), F.lit(size).cast("long").alias("file_size"))


class Decoder:
    """Hashes by place: every fifth photo fails, and photos of one ten are near each other."""

    def __init__(self, fail_at=None):
        self.seen, self.fail_at = [], fail_at

    def __call__(self, batch):
        rows = sorted(r["photo_idx"] for r in batch.collect())
        if self.fail_at in rows:
            raise RuntimeError("lost")
        self.seen.append(rows)
        ok = F.col("photo_idx") % 5 != 0
        return batch.select(
            "photo_idx", "path", "file_size", F.when(ok, F.expr("(photo_idx div 10) * 1103515245 * 65537 + photo_idx % 2")).otherwise(0).alias("hash"), F.lit(1.0).alias("sharpness"),
            F.lit(None).cast(dict(x.split(" ", 1) for x in SEEN.split(", "))["date"]).alias("date"), F.lit(4).alias("width"), F.lit(3).alias("height"), ok.alias("decoded"))


def lists(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def folder(spark):
    return new_folder(spark, "scan")


def test_cancelled_and_resumed(spark, folder):
    paths, first, told = listing(spark, 95), Decoder(), []
    part = resume.scan_batches(paths, first, folder, batch=20, cancelled=lambda: len(first.seen) == 2, on_batch=told.append)
    assert first.seen == [list(range(20)), list(range(20, 40))]
    assert sorted(r["photo_idx"] for r in part.photos.collect()) == list(range(40))
    assert part.memberships.collect() == [] and tuple(part.stats.first()) == (0, 0)
    assert [(p.done, p.total, p.failed) for p in told] == [(20, 95, 4), (40, 95, 8)]
    second = Decoder()
    whole = resume.scan_batches(paths, second, folder, batch=20, on_batch=told.append)
    assert second.seen == [list(range(40, 60)), list(range(60, 80)), list(range(80, 95))]
    assert [(p.done, p.failed) for p in told[2:]] == [(60, 12), (80, 16), (95, 19)]
    plain = library.scan_photos(Decoder()(paths))
    assert lists(whole.photos.select(*resume.COLUMNS)) == lists(plain.photos.select(*resume.COLUMNS))
    assert lists(whole.memberships) == lists(plain.memberships) != [] and tuple(whole.stats.first()) == tuple(plain.stats.first())
    assert whole.summary().first()["failed"] == told[-1].failed
    # nothing is left to decode
    third = Decoder()
    assert lists(resume.scan_batches(paths, third, folder, batch=20).memberships) == lists(plain.memberships) and third.seen == []


def test_jobs_do_not_grow_with_the_library(spark, folder):
    paths, first = listing(spark, 95), Decoder()
    resume.scan_batches(paths, first, folder, batch=5, steps=4, cancelled=lambda: len(first.seen) == 2)
    assert first.seen == [list(range(25)), list(range(25, 50))]
    second = Decoder()
    whole = resume.scan_batches(paths, second, folder, batch=5, steps=4)
    assert second.seen == [list(range(50, 65)), list(range(65, 80)), list(range(80, 95))]
    plain = library.scan_photos(Decoder()(paths))
    assert lists(whole.photos.select(*resume.COLUMNS)) == lists(plain.photos.select(*resume.COLUMNS)) and lists(whole.memberships) == lists(plain.memberships) != []


def test_a_lost_batch_does_not_count(spark, folder):
    paths = listing(spark, 60)
    with pytest.raises(RuntimeError):
        resume.scan_batches(paths, Decoder(fail_at=45), folder, batch=20)
    # files of a batch that never came into the manifest
    Decoder()(paths.filter("photo_idx >= 40")).write.parquet(f"{folder}/batches/half")
    assert resume.kept_photos(spark, folder).count() == 40
    again = Decoder()
    whole = resume.scan_batches(paths, again, folder, batch=20)
    assert again.seen == [list(range(40, 60))] and whole.photos.count() == 60


def test_changed_and_new_files(spark, folder):
    resume.scan_batches(listing(spark, 30), Decoder(), folder, batch=10)
    changed = listing(spark, 40).withColumn("file_size", F.when(F.col("photo_idx") == 7, 99).otherwise(F.col("file_size")).cast("long"))
    decoder = Decoder()
    whole = resume.scan_batches(changed, decoder, folder, batch=10)
    assert decoder.seen == [[7], list(range(30, 40))]
    assert sorted((r["photo_idx"], r["file_size"]) for r in whole.photos.collect()) == [(i, 99 if i == 7 else 10) for i in range(40)]
    # a file that is gone is no photo of the scan, though its batch holds it
    assert resume.scan_batches(listing(spark, 20), Decoder(), folder, batch=10).photos.count() == 19 + 1


def test_empty(spark, folder):
    done = resume.scan_batches(listing(spark, 0), Decoder(), folder)
    assert done.photos.collect() == [] and done.memberships.collect() == [] and tuple(done.stats.first()) == (0, 0)
    assert resume.kept_photos(spark, new_folder(spark, "none")).collect() == []


def test_reports_are_about_two_hundred():
    told = []
    tell = resume.reports(told.append)
    for n in range(1, 10_001):
        tell(resume.Progress(n, 10_000, 0))
    assert 190 <= len(told) <= 210 and told[-1].done == 10_000
    few = []
    tell = resume.reports(few.append)
    for n in (3000, 3010, 10_000):
        tell(resume.Progress(n, 10_000, 0))
    assert [p.done for p in few] == [3000, 10_000]
