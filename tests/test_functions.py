"""Hashes, rasters, capture times and paths."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import blurred, brighter, noisy, scene

from nearkin.functions import bits, exif, paths, raster, signature

LE = bytes.fromhex("FFD8FFE1004845786966000049492A0008000000010069870400010000001A00000000000000010003900200140000002C00000000000000323032363A30373A31342031383A30353A333000FFD9")
BE = bytes.fromhex("FFD8FFE100484578696600004D4D002A00000008000187690004000000010000001A00000000000190030002000000140000002C00000000313939393A31323A33312032333A35393A353900FFD9")


# Images

GOLDEN = [
    (scene(64, 64), 0x0C0C00, 1105.190947),
    (brighter(scene(64, 64), 30), 0x0C0C00, 1105.190947),
    (brighter(scene(64, 64), 120), 0x0C0C00, 301.395420),
    (scene(64, 64, 2), 0x606000, 782.768470),
    (blurred(scene(64, 64), 1), 0x0C0C00, 214.079589),
    (blurred(scene(64, 64), 2), 0x0C0C00, 88.544197),
    (blurred(scene(64, 64), 4), 0x0C0C00, 35.570314),
    (scene(128, 128), 0x0C0C00, 518.692744),
    (scene(128, 128, 3), 0xC0C000, 291.544848),
    (noisy(scene(128, 128), 12, 1), 0x0C0C00, 1549.789184),
    (noisy(scene(128, 128), 10, 7), 0x0C0C00, 1245.943095),
    (np.zeros((0, 0), np.uint8), 0, 0.0),
    (np.full((5, 9), 77, np.uint8), 0, 0.0),
    (np.full((2, 2), 3, np.uint8), 0, 0.0),
    (np.full((40, 1), 3, np.uint8), 0, 0.0),
]


def frame_of(spark, images):
    rows = [(i, g.shape[1] if g.size else 0, g.shape[0] if g.size else 0, [int(p) for p in g.reshape(-1)]) for i, g in enumerate(images)]
    return spark.createDataFrame(rows, "i int, w int, h int, p array<int>")


def test_golden_images(spark):
    for img, h, v in GOLDEN:
        assert raster.np_difference_hash(img) == h
        assert raster.np_laplacian_variance(img) == pytest.approx(v, abs=1e-6)
    df = frame_of(spark, [g[0] for g in GOLDEN])
    got = df.select("i", raster.difference_hash("p", "w", "h").alias("d"), raster.laplacian_variance("p", "w", "h").alias("v")).collect()
    for r in got:
        assert r["d"] == GOLDEN[r["i"]][1] and r["v"] == pytest.approx(GOLDEN[r["i"]][2], abs=1e-6)


def test_column_and_array_forms_agree(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (h, w)).astype(np.uint8) for w, h in [(1, 1), (2, 2), (3, 3), (9, 8), (8, 9), (5, 30), (40, 3), (64, 64)]]
    images.append(np.tile(np.arange(64, 0, -1), (64, 1)).astype(np.uint8))  # all bits set: a negative long
    df = frame_of(spark, images)
    for to_w, to_h in [(9, 8), (1, 1), (5, 3), (0, 4)]:
        for r in df.select("i", raster.box_downscale("p", "w", "h", to_w, to_h).alias("b")).collect():
            assert r["b"] == [int(x) for x in raster.np_box_downscale(images[r["i"]], to_w, to_h).reshape(-1)]
    for r in df.select("i", raster.difference_hash("p", "w", "h").alias("d"), raster.laplacian_variance("p", "w", "h").alias("v")).collect():
        assert r["d"] == raster.np_difference_hash(images[r["i"]]) and r["v"] == raster.np_laplacian_variance(images[r["i"]])
    assert raster.np_difference_hash(images[-1]) == -1
    assert raster.np_box_downscale(np.array([[0, 100], [200, 255]], np.uint8), 1, 1).tolist() == [[138]]


def test_invalid_raster(spark):
    bad = spark.createDataFrame([(3, 3, [1, 2]), (None, 3, [1] * 9), (3, 3, None), (-1, -1, [1])], "w int, h int, p array<int>")
    got = bad.select(raster.difference_hash("p", "w", "h"), raster.laplacian_variance("p", "w", "h"), F.size(raster.box_downscale("p", "w", "h", 9, 8))).collect()
    assert {tuple(r) for r in got} == {(0, 0.0, 0)}


# Bits

def test_bits(spark):
    values = [0, 1, -1, -(1 << 63), (1 << 63) - 1, 0x0123456789ABCDEF]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long")
    for r in df.select("a", "b", bits.hamming(F.col("a"), F.col("b")).alias("d"), bits.popcount(F.col("a")).alias("n"), bits.hash_hex(F.col("a")).alias("x"), *[bits.band_value(F.col("a"), k).alias(f"b{k}") for k in range(8)]).collect():
        a, b = r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1
        assert (r["d"], r["n"], r["x"]) == ((a ^ b).bit_count(), a.bit_count(), f"{a:016x}")
        assert [r[f"b{k}"] for k in range(8)] == [a >> 8 * k & 255 for k in range(8)]
    assert [bits.clamp_threshold(t) for t in (-3, 0, 5, 7, 8, 99)] == [0, 0, 5, 7, 7, 7]


# Capture times

def test_exif_goldens_and_truncations():
    assert exif.read_date(LE) == (2026, 7, 14, 18, 5, 30) and exif.read_date(BE) == (1999, 12, 31, 23, 59, 59)
    for data in (LE, BE):
        for n in range(len(data)):
            assert (exif.read_date(data[:n]) is not None) == (n >= len(data) - 2)
    assert exif.read_date(None) is None and exif.read_date(b"") is None and exif.read_date(b"\x89PNG....") is None


def test_exif_mutations_never_fail(spark):
    mutated = [data[:i] + bytes([v]) + data[i + 1 :] for data in (LE, BE) for i in range(len(data)) for v in (0, 255)]
    got = spark.createDataFrame([(i, m) for i, m in enumerate(mutated)], "i int, b binary").select("i", exif.exif_date(F.col("b")).alias("d")).collect()
    for r in got:
        want = exif.read_date(mutated[r["i"]])
        assert (None if r["d"] is None else tuple(r["d"])) == want


@pytest.mark.parametrize(
    ("text", "date"),
    [
        ("0000:00:00 00:00:00", None), ("2026:13:01 00:00:00", None), ("2026:01:32 00:00:00", None), ("2026:01:01 25:00:00", None), ("1825:01:01 00:00:00", None),
        ("1826:01:01 00:00:00", (1826, 1, 1, 0, 0, 0)), ("2026:02:31 23:59:60", (2026, 2, 31, 23, 59, 60)), ("2026:07:1418:05:30", (2026, 7, 14, 18, 5, 30)),
        ("2026: 7: 4  8: 5: 3", (2026, 7, 4, 8, 5, 3)), ("2026:07:14:05:30:00", None), ("20260:07:14 05:30:0", None), ("2026:+7:14 05:30:00", (2026, 7, 14, 5, 30, 0)), ("garbage", None)],
)
def test_date_text(text, date):
    assert exif.parse_date(text.encode()) == date


def tiff_jpeg(entries, sub=(), before=b"", texts=()):
    """A little-endian JPEG: IFD0 entries (tag, text number), sub-IFD entries, texts of 20 bytes."""
    ifd0 = 8
    n0 = len(entries) + bool(sub)
    at_sub = ifd0 + 2 + 12 * n0 + 4
    at_text = at_sub + (2 + 12 * len(sub) + 4 if sub else 0)
    body = b"II" + struct.pack("<HI", 42, ifd0) + struct.pack("<H", n0)
    for tag, k in entries:
        body += struct.pack("<HHII", tag, 2, 20, at_text + 20 * k)
    if sub:
        body += struct.pack("<HHII", exif.TAG_SUB_IFD, 4, 1, at_sub)
    body += b"\0" * 4
    if sub:
        body += struct.pack("<H", len(sub)) + b"".join(struct.pack("<HHII", tag, 2, 20, at_text + 20 * k) for tag, k in sub) + b"\0" * 4
    body += b"".join(t.encode().ljust(20, b"\0") for t in texts)
    payload = b"Exif\0\0" + body
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(payload) + 2) + payload + b"\xff\xd9"


GOOD, BAD, OTHER = "2020:01:02 03:04:05", "2020:13:02 03:04:05", "2011:11:11 11:11:11"


def test_exif_precedence():
    good, other = (2020, 1, 2, 3, 4, 5), (2011, 11, 11, 11, 11, 11)
    t = [GOOD, BAD, OTHER]
    assert exif.read_date(tiff_jpeg([(0x132, 0)], texts=t)) == good
    assert exif.read_date(tiff_jpeg([(0x132, 0), (0x132, 1)], texts=t)) is None
    assert exif.read_date(tiff_jpeg([(0x132, 0)], [(0x9004, 2)], texts=t)) == other
    assert exif.read_date(tiff_jpeg([], [(0x9003, 1), (0x9004, 2)], texts=t)) == other
    assert exif.read_date(tiff_jpeg([], [(0x9003, 0), (0x9003, 1)], texts=t)) == good
    assert exif.read_date(tiff_jpeg([(0x132, 0)], [(0x9003, 1)], texts=t)) == good
    xmp = b"\xff\xe1" + struct.pack(">H", 12) + b"http://x\0\0"
    assert exif.read_date(tiff_jpeg([(0x132, 0)], texts=t, before=xmp)) == good
    assert exif.read_date(tiff_jpeg([(0x132, 0)], texts=t, before=tiff_jpeg([(0x132, 1)], texts=t)[2:-2])) is None
    assert exif.read_date(tiff_jpeg([(0x132, 0)], texts=t, before=b"\xff\xff\xff\x01\xff\xd3")) == good
    assert exif.read_orientation(LE) == 1


def hostile_files():
    rng = random.Random(5)
    t, xmp = [GOOD, BAD, OTHER], b"\xff\xe1" + struct.pack(">H", 12) + b"http://x\0\0"
    subs = [(), [(0x9004, 2)], [(0x9003, 1), (0x9004, 2)], [(0x9003, 0), (0x9003, 1)], [(0x9003, 1)], [(0x9003, 0), (0x9003, 2), (0x9004, 1)]]
    whole = [tiff_jpeg(e, sub, b, t) for e in ([], [(0x132, 0)], [(0x132, 0), (0x132, 1)], [(0x132, 1), (0x132, 2)]) for sub in subs for b in (b"", xmp)]
    few = b"\xff\xe0\x00\x02"
    # fill bytes, bare markers, more segments than a tier has steps, the most a prefix holds, and no end at all
    befores = [b"\xff\xff\xff\x01\xff\xd3", few * 40, few * 1100, few * 5000, few * 40000, b"\xff" * 70, b"\xff" * 5000, b"\xff" * 140000, b"\xff\xd9", b"\xff\xda", b"\xff\xe0\x00\x01", b"\xff\xe0\xff\xff", b"\x00", tiff_jpeg([(0x132, 1)], texts=t)[2:-2]]
    whole += [tiff_jpeg([(0x132, 0)], [(0x9003, 2)], b, t) for b in befores]
    whole += [few, b"\xff\xd8", b"\xff\xd8\xff", b"\xff\xd8\xff\xff", b"\xff\xd8\xff\xff\xff", b"", None]
    whole += [d[:n] for d in (LE, BE, whole[-25]) for n in range(0, len(d), 3)]
    small = [d for d in whole if d and 20 < len(d) < 400]
    for _ in range(400):
        d = bytearray(rng.choice(small))
        for _ in range(rng.randint(1, 4)):
            d[rng.randrange(len(d))] = rng.choice([0, 1, 2, 8, 19, 32, 48, 58, 127, 128, 255, rng.randrange(256)])
        whole.append(bytes(d))
    return whole


def test_exif_expressions_are_the_python_form(spark):
    files = hostile_files()
    got = spark.createDataFrame(list(enumerate(files)), "i int, b binary").select("i", exif.exif_date(F.col("b")).alias("d"), exif.exif_orientation(F.col("b")).alias("o")).collect()
    dated = 0
    for r in got:
        prefix = None if files[r["i"]] is None else files[r["i"]][: exif.PREFIX_BYTES]
        assert (None if r["d"] is None else tuple(r["d"])) == exif.read_date(prefix), prefix[:300]
        assert r["o"] == exif.read_orientation(prefix)
        dated += r["d"] is not None
    assert len(got) == len(files) and dated > 50


def test_date_texts_as_expressions(spark):
    texts = ["2026:02:31 23:59:60", "2026:07:1418:05:30", "2026: 7: 4  8: 5: 3", "2026:+7:14 05:30:00", "+202:07:14 05:30:00", "-202:07:14 05:30:00", "20260:07:14 05:30:0", "2026:07:14 05:30:0\0", "1825:01:01 00:00:00",
             "\t\v2026:1:2 3:4:5zzz", "2026:-7:14 05:30:00", "2026:07:14\n05:30:00", "garbage", "", "2026:07:14 05:30:\u0660", "2026:07:14 05:30:0\n", "1,2,3,4,5,6", "2026:1:2 3:4:5\n\n\u0085"]
    data = [t.encode("utf-8") for t in texts] + [t.encode("latin-1", "replace") for t in texts] + [None]
    for r in spark.createDataFrame(list(enumerate(data)), "i int, b binary").select("i", exif.date_of_text(F.col("b")).alias("d")).collect():
        assert (None if r["d"] is None else tuple(r["d"])) == (None if data[r["i"]] is None else exif.parse_date(data[r["i"]])), data[r["i"]]


def test_format_date(spark):
    df = spark.createDataFrame([(LE,), (None,), (b"x",)], "b binary").select(exif.format_date(exif.exif_date(F.col("b"))))
    assert [r[0] for r in df.collect()] == ["2026-07-14 18:05:30", None, None]


# Paths

def test_paths(spark):
    names = ["a.jpg", "x.tar.gz", ".hidden", ".a.b", "none", "dot.", "", "a b (2).jpeg"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", paths.stem(F.col("n")).alias("s"), paths.extension(F.col("n")).alias("e")).collect()
    assert [(r["s"], r["e"]) for r in got] == [("a", ".jpg"), ("x.tar", ".gz"), (".hidden", ""), (".a", ".b"), ("none", ""), ("dot", "."), ("", ""), ("a b (2)", ".jpeg")]
    files = {"C:/d/IMG.jpg": "IMG.jpg", "C:\\d\\IMG.jpg": "IMG.jpg", "/a\\b/c.png": "c.png", "plain": "plain", "/end/": ""}
    got = spark.createDataFrame([(p,) for p in files], "p string").select("p", paths.file_name(F.col("p")).alias("f")).collect()
    assert {r["p"]: r["f"] for r in got} == files
    roots = {"D:/Photos": "D:/Photos", "D:/Photos/": "D:/Photos", "D:\\Photos\\/": "D:\\Photos", "/": "/", "//": "/", "": ""}
    got = spark.createDataFrame([(p,) for p in roots], "p string").select("p", paths.trim_root(F.col("p")).alias("f")).collect()
    assert {r["p"]: r["f"] for r in got} == roots
    df = spark.createDataFrame([("/", 2026, 7), ("D:/P/", 826, 12), ("x", None, None)], "r string, y int, m int")
    assert [r[0] for r in df.select(paths.destination_folder(F.col("r"), F.col("y"), F.col("m"))).collect()] == ["//2026/2026-07", "D:/P/0826/0826-12", "x/Undated"]
    ext = {"a.JPG": True, "b.jpeg": True, "c.tiff": False, "d.gif": False, ".webp": True, "e.tif": True, "jpg": False, "f.png.txt": False}
    got = spark.createDataFrame([(p,) for p in ext], "p string").select("p", paths.has_photo_extension(F.col("p")).alias("f")).collect()
    assert {r["p"]: r["f"] for r in got} == ext
    sizes = {0: "0 KB", 2048: "2 KB", 1048575: "1024 KB", 1048576: "1.0 MB", 5 * 1048576 + 524288: "5.5 MB"}
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", paths.human_size(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == sizes


def test_halves_of_sizes_go_to_the_even_digit(spark):
    sizes = {5 * (1 << 18): "1.2 MB", 7 * (1 << 18): "1.8 MB", 997 * (1 << 18): "249.2 MB", 5 * (1 << 18) + 1: "1.3 MB", 5 * (1 << 18) - 1: "1.2 MB", (1 << 50) + (1 << 18): "1073741824.2 MB", 2560: "2 KB", 3584: "4 KB"}
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", paths.human_size(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == sizes


def test_signatures_of_odd_texts(spark):
    texts = [(1, "A b\nb  c", 1), (2, None, 2), (3, "", 3), (4, " \n ", 4), (5, "Ä ö\tx Ä\u00a0y \U0001f600", None), (6, "a b", 6), (6, "b c d", 7), (7, "w" * 5000 + " " + "v " * 3000, 8)]

    def want(many):
        n = [0] * 72
        for w in (w for t in many for w in (t or "").lower().replace("\n", " ").split(" ") if w):
            n[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 72] += 1
        bits_set = sum(1 << b for b in range(64) if n[b // 8 * 9 + b % 8] > n[b // 8 * 9 + b % 8 + 1])
        return bits.signed(bits_set)

    df = spark.createDataFrame(texts, "doc_id long, text string, k int")
    hashes = {i: want([t for j, t, _ in texts if j == i]) for i, _, _ in texts}
    assert sorted(map(tuple, signature.text_signatures(df).collect())) == sorted(hashes.items())
    got = signature.cell_signatures(signature.text_cells(df, kept=("k",)), "words", "k").collect()
    words = lambda t: None if t is None else len({w for w in t.lower().replace("\n", " ").split(" ") if w})
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(((i, hashes[i], words(t), k) for i, t, k in texts), key=order)
    assert signature.text_signatures(df.limit(0)).collect() == []
