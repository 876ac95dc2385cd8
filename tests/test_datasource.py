"""The data source of photos: decoders of one's own, packed contents, prefixes."""

import numpy as np
import pytest
from test_groups import png
from tests_support import scene

from nearkin.functions.raster import np_difference_hash
from nearkin.queries import BIG, LITTLE
from nearkin.runtime import ship
from nearkin.sources import datasource


def jpeg(head, text, size=0):
    return bytes.fromhex(head) + text.encode() + bytes.fromhex("00FFD9") + b"\0" * size


@pytest.fixture(scope="module")
def photos(spark):
    return lambda path, **options: datasource.register(ship(spark)).read.format("photos").options(**options).load(str(path))


def test_files(photos, tmp_path):
    (tmp_path / "sub dir").mkdir()
    for name in ("a.jpg", "sub dir/b.JPEG", ".hidden.png"):
        (tmp_path / name).write_bytes(np.arange(64, dtype=np.uint8)[:: -1 if "b" in name else 1].tobytes())
    (tmp_path / "broken.png").write_bytes(b"x" * 63)
    (tmp_path / "empty.bmp").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"x" * 64)
    for most in (1, 1 << 20):
        got = {r["path"].removeprefix(f"{tmp_path}/"): r for r in photos(tmp_path, decoder="nearkin.queries:square", partitionBytes=str(most)).collect()}
        assert sorted(got) == [".hidden.png", "a.jpg", "broken.png", "empty.bmp", "sub dir/b.JPEG"]
        assert got["sub dir/b.JPEG"]["hash"] == np_difference_hash(np.arange(64, dtype=np.uint8)[::-1].reshape(8, 8)) != got["a.jpg"]["hash"]
        assert [got[k]["decoded"] for k in sorted(got)] == [True, True, False, False, True] and got["broken.png"]["file_size"] == 63
    assert photos(tmp_path, decoder="nearkin.queries:square", partitionBytes="1").rdd.getNumPartitions() == 5


def test_prefixes(photos, tmp_path):
    """Of a file no more than 128 KiB are read for its capture time."""
    (tmp_path / "long.jpg").write_bytes(jpeg(LITTLE, "2026:07:14 18:05:30", 3_000_000))
    (tmp_path / "big.jpg").write_bytes(jpeg(BIG, "2020:01:02 03:04:05"))
    (tmp_path / "late.jpg").write_bytes(b"\xff\xd8" + b"\xff\xe0\xff\xff" + b"\0" * 65533 + b"\xff\xe0\xff\xff" + b"\0" * 65533 + jpeg(BIG, "2020:01:02 03:04:05")[2:])
    (tmp_path / "plain.png").write_bytes(png(scene(20, 20)))
    got = {r["path"].rpartition("/")[2]: r for r in photos(tmp_path, tags="true").collect()}
    assert {k: r["bytes_read"] for k, r in got.items()} == {k: min(131072, (tmp_path / k).stat().st_size) for k in got} and len(got) == 4
    assert tuple(got["long.jpg"]["date"]) == (2026, 7, 14, 18, 5, 30) and tuple(got["big.jpg"]["date"])[:2] == (2020, 1)
    assert got["late.jpg"]["date"] is None and got["plain.png"]["date"] is None and got["long.jpg"]["file_size"] > 3_000_000


def test_packed(spark, photos, tmp_path):
    rows = [(f"p{i}", bytearray(bytes(range(64)) if i % 3 else b"z")) for i in range(1000)] + [("none", None)]
    spark.createDataFrame(rows, "path string, content binary").repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    df = photos(tmp_path / "t", packed="true", decoder="nearkin.queries:square", partitionBytes="1")
    got = {r["path"]: r["decoded"] for r in df.collect()}
    assert got == {p: c is not None and len(c) == 64 for p, c in rows} and df.rdd.getNumPartitions() >= 3
    dates = photos(tmp_path / "t", packed="true", tags="true").collect()
    assert len(dates) == 1001 and all(r["date"] is None for r in dates)


def test_a_decoder_is_needed(photos, tmp_path):
    with pytest.raises(Exception, match="decoder"):
        photos(tmp_path).collect()
