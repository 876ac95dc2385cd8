"""Pairs, groups, keepers and organise plans against brute force."""

import os
import random
import re
import struct
import threading
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.operators import components, keeper, neardup, organize
from nearkin.operators.components import connected_components
from nearkin.plans import actions, library
from nearkin.sources import images

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


class Xorshift:
    """xorshift64*: a fixed generator, for the goldens."""

    def __init__(self, seed):
        self.s = seed

    def next(self):
        s = self.s
        s ^= s >> 12
        s = (s ^ s << 25) & MASK
        self.s = s = s ^ s >> 27
        return s * 0x2545F4914F6CDD1D & MASK


def clustered(clusters, per, loners, t, seed=0x9E3779B97F4A7C15):
    rng, out = Xorshift(seed), []
    for _ in range(clusters):
        base = rng.next()
        out.append(base)
        for _ in range(per - 1):
            h = base
            for _ in range(rng.next() % (t + 2)):
                h ^= 1 << rng.next() % 64
            out.append(h)
    return out + [rng.next() for _ in range(loners)]


def groups_brute(hashes, t):
    label = list(range(len(hashes)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = [(i, j) for j in range(len(hashes)) for i in range(j) if (hashes[i] ^ hashes[j]).bit_count() <= t]
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        label[b] = a
    groups = defaultdict(list)
    for i in range(len(hashes)):
        groups[find(i)].append(i)
    return pairs, [g for g in groups.values() if len(g) > 1]


def frame(spark, hashes):
    return spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "idx long, hash long")


def lists(members):
    return [r["members"] for r in neardup.group_lists(members).orderBy("group_id").collect()]


@pytest.mark.parametrize(("clusters", "per", "loners", "t", "groups", "members", "comparisons", "naive"), [
    (25, 4, 100, 2, 25, 81, 660, 19900), (25, 4, 100, 3, 25, 86, 834, 19900), (15, 6, 80, 5, 15, 83, 673, 14365), (10, 8, 60, 7, 10, 76, 584, 9730)])
def test_fast_equals_brute_force(spark, clusters, per, loners, t, groups, members, comparisons, naive):
    hashes = clustered(clusters, per, loners, t)
    pairs, want = groups_brute(hashes, t)
    df = frame(spark, hashes)
    got = lists(neardup.near_groups(df, t))
    assert got == want
    stats = neardup.candidate_stats(df).first()
    shared = sum(any((a ^ b) >> 8 * k & 255 == 0 for k in range(8)) for i, a in enumerate(hashes) for b in hashes[:i])
    assert (stats["comparisons"], stats["naive_comparisons"]) == (shared, naive)
    assert sorted((r["a"], r["b"], r["distance"]) for r in neardup.near_pairs(df, t).collect()) == sorted((i, j, (hashes[i] ^ hashes[j]).bit_count()) for i, j in pairs)
    assert neardup.band_candidates(df).count() == shared
    if len(hashes) == naive_n(naive) and shared == comparisons:
        assert (len(got), sum(map(len, got))) == (groups, members)


def naive_n(pairs):
    return int((1 + (1 + 8 * pairs) ** 0.5) / 2)


@pytest.mark.parametrize(("hashes", "t", "want"), [
    ([0xABCDEF0123456789] * 2, 0, [[0, 1]]), ([0, MASK], 3, []), ([0b000, 0b111], 2, []), ([0b000, 0b111], 3, [[0, 1]]),
    ([0b0000, 0b0011, 0b1111], 2, [[0, 1, 2]]), ([], 3, []), ([42], 3, []), ([0b000, 0b111], 99, [[0, 1]]), ([5, 5, 4], -1, [[0, 1]])])
def test_small_groups(spark, hashes, t, want):
    df = frame(spark, hashes)
    assert lists(neardup.near_groups(df, t)) == want
    n = len(hashes)
    assert tuple(neardup.candidate_stats(df).first())[1] == n * (n - 1) // 2


@pytest.mark.parametrize(("t", "free"), [(0, 2), (3, 3), (3, 5), (5, 4), (7, 2), (7, 6)])
def test_keys_of_any_length_find_each_pair_once(spark, t, free):
    hashes = sorted(set(clustered(12, 6, 40, t)) | {0, 1, MASK, MASK >> 1})
    want = sorted((signed(x), signed(y), (x ^ y).bit_count()) for x in hashes for y in hashes if signed(x) < signed(y) and (x ^ y).bit_count() <= t)
    got = neardup.distinct_hash_pairs(frame(spark, hashes).select("hash"), t, free)
    assert sorted(map(tuple, got.collect())) == want


def test_longer_keys_for_larger_tables():
    for t in range(8):
        chosen = [neardup.free_blocks(10**k, t) for k in range(13)]
        assert chosen == sorted(chosen) and chosen[0] == 2
    assert neardup.free_blocks(0, 7) == 2 and neardup.free_blocks(10**9, 7) > 3


def test_hot_hash_makes_no_pairs(spark):
    df = spark.range(20_000).select(F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.xxhash64("id")).alias("hash"))
    assert neardup.near_groups(df, 3).count() >= 6667
    stats = neardup.candidate_stats(df).first()
    assert stats["comparisons"] >= 6667 * 6666 // 2


@pytest.mark.parametrize("hot", [1, 4, 60])
def test_hot_groups_of_bands_are_split(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    hashes = clustered(15, 6, 60, 5) + [0, 0, 1, MASK] + [k << 56 for k in range(1, 40)]
    shared = sum(any((a ^ b) >> 8 * k & 255 == 0 for k in range(8)) for i, a in enumerate(hashes) for b in hashes[:i])
    assert tuple(neardup.candidate_stats(frame(spark, hashes)).first()) == (shared, len(hashes) * (len(hashes) - 1) // 2)


def test_a_hash_is_sent_once_a_band(spark, monkeypatch):
    sent, shared = [], neardup._shared
    monkeypatch.setattr(neardup, "_shared", lambda keyed, rows: sent.append(keyed.count()) or shared(keyed, rows))
    assert neardup.candidate_stats(spark.range(3000).select(F.col("id").alias("idx"), F.xxhash64("id").alias("hash"))).first()["comparisons"] > 0
    assert sent == [8 * 3000]


def test_candidates_are_counted_only_when_asked_for(spark, monkeypatch):
    photos = spark.range(20).select(F.col("id").alias("photo_idx"), F.expr("(id div 4) * 1103515245 * 65537 + id % 2").alias("hash"), F.lit(1.0).alias("sharpness"), F.lit(4).alias("width"), F.lit(3).alias("height"), F.lit(True).alias("decoded"))
    counted, stats = [], neardup.candidate_stats
    monkeypatch.setattr(neardup, "candidate_stats", lambda hashes: counted.append(1) or stats(hashes))
    result = library.scan_photos(photos)
    groups = result.keepers().count()
    assert result.memberships.count() == 20 and result.removal_marks().count() == 20 - groups and groups > 1 and counted == []
    assert result.stats.first()["naive_comparisons"] == 190 and result.summary().count() == 1 and counted == [1]


@pytest.mark.parametrize("hub", [10_000, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    monkeypatch.setattr(components, "MOST_HUBS", 10**6)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)] + [(7, 7), (5000, 5000), (None, 3)]
    edges += [(3, 7000 + i) for i in range(60)] + [(7100 + i, 9000) for i in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}

    def find(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    assert got == {i: find(i) for i in label}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keeper_marks_and_regroup(spark):
    members = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (3, 3), (3, 4), (5, 5), (5, 6)], "group_id long, idx long")
    scores = spark.createDataFrame([(0, 1.0, 10, 10), (1, 2.0, 1, 1), (2, 2.0, 3, 3), (3, 5.0, 2, 8), (4, 5.0, 4, 4), (5, 0.1, 1, 1), (6, 0.2, 1, 1)], "idx long, sharpness double, width int, height int")
    best = keeper.keepers(members, scores)
    assert {tuple(r) for r in best.collect()} == {(0, 2), (3, 3), (5, 6)}
    assert {r["idx"] for r in keeper.removal_marks(members, best).collect()} == {0, 1, 4, 5}
    left = keeper.regroup(members, spark.createDataFrame([(0,), (3,), (99,)], "idx long"))
    assert sorted(map(tuple, left.collect())) == [(1, 1), (1, 2), (5, 5), (5, 6)]


# Organise plans

DATE = "struct<year:int,month:int,day:int,hour:int,minute:int,second:int>"
JULY = (2026, 7, 14, 18, 5, 30)


def plan_of(spark, photos, root="D:/Photos", occupied=None, selection=None, strict=False):
    df = spark.createDataFrame([(i, p, d) for i, (p, d) in enumerate(photos)], f"photo_idx long, path string, date {DATE}")
    sel = spark.createDataFrame([(k, i) for k, i in enumerate(range(len(photos)) if selection is None else selection)], "pos long, photo_idx long")
    occ = None if occupied is None else spark.createDataFrame([(p,) for p in occupied], "path string")
    return organize.organise_plan(df, sel, root, occ, strict)


def rows_of(plan):
    return [(r["destination"], r["undated"], r["action"]) for r in plan.orderBy("pos").collect()]


@pytest.mark.parametrize(("photos", "options", "want"), [
    ([("C:/dump/IMG_1.jpg", JULY)], {}, ["D:/Photos/2026/2026-07/IMG_1.jpg"]),
    ([("C:/dump/scan.png", None)], {}, ["D:/Photos/Undated/scan.png"]),
    ([("C:/d/a.jpg", JULY)], {"occupied": ["D:/Photos/2026/2026-07/a.jpg"]}, ["D:/Photos/2026/2026-07/a (2).jpg"]),
    ([("a/x.jpg", JULY), ("b/x.jpg", JULY), ("c/x.jpg", JULY)], {"root": "r/"}, ["r/2026/2026-07/x.jpg", "r/2026/2026-07/x (2).jpg", "r/2026/2026-07/x (3).jpg"]),
    ([("a/h.jpeg", None), ("b/h.jpeg", None)], {"root": "r"}, ["r/Undated/h.jpeg", "r/Undated/h (2).jpeg"]),
    ([("a/x.jpg", None), ("a/x (2).jpg", None), ("b/x.jpg", None)], {"root": "r"}, ["r/Undated/x.jpg", "r/Undated/x (2).jpg", "r/Undated/x (3).jpg"]),
    ([("a/x.jpg", None), ("b/x.jpg", None), ("a/x (2).jpg", None)], {"root": "r"}, ["r/Undated/x.jpg", "r/Undated/x (2).jpg", "r/Undated/x (2) (2).jpg"]),
    ([("a/.hidden", None), ("b\\.hidden", None), ("c/x.tar.gz", None), ("d/x.tar.gz", None)], {"root": "r"}, ["r/Undated/.hidden", "r/Undated/.hidden (2)", "r/Undated/x.tar.gz", "r/Undated/x.tar (2).gz"]),
    ([("x/a.jpg", JULY)], {"selection": [0, 99], "root": "/"}, ["//2026/2026-07/a.jpg"])])
def test_organise(spark, photos, options, want):
    assert [d for d, _, _ in rows_of(plan_of(spark, photos, **options))] == want


def test_in_place_photo(spark):
    here = [("r/Undated/a.jpg", None)]
    assert rows_of(plan_of(spark, here, "r")) == [("r/Undated/a.jpg", True, "unchanged")]
    assert rows_of(plan_of(spark, here, "r", ["r/Undated/a.jpg"])) == [("r/Undated/a.jpg", True, "unchanged")]
    assert rows_of(plan_of(spark, here, "r", ["r/Undated/a.jpg"], strict=True)) == [("r/Undated/a (2).jpg", True, "move")]
    counts = organize.organise_counts(plan_of(spark, [*here, ("q/b.jpg", JULY)], "r")).first()
    assert tuple(counts) == (1, 1, 1)


def organise_brute(photos, root, occupied):
    claimed, out = set(), []
    for path, date in photos:
        name = re.split(r"[/\\]", path)[-1]
        folder = f"{root}/{date[0]:04d}/{date[0]:04d}-{date[1]:02d}" if date else f"{root}/Undated"
        dot = name.rfind(".")
        head, tail = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        to, k = f"{folder}/{name}", 2
        while to in claimed or (to in occupied and to != path):
            to, k = f"{folder}/{head} ({k}){tail}", k + 1
        claimed.add(to)
        out.append(to)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_organise_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a.jpg", "a (2).jpg", "a (3).jpg", "a (2) (2).jpg", "b.png", "c", "c (2)", ".d"]
    photos = [(f"{rng.choice(['x', 'y', 'r/Undated', 'r/2026/2026-07'])}/{rng.choice(names)}", rng.choice([None, JULY])) for _ in range(120)]
    occupied = {f"r/{rng.choice(['Undated', '2026/2026-07'])}/{n}" for n in names[:6] if rng.random() < 0.5} | {p for p, _ in photos if p.startswith("r/") and rng.random() < 0.5}
    plan = plan_of(spark, photos, "r", sorted(occupied))
    assert [d for d, _, _ in rows_of(plan)] == organise_brute(photos, "r", occupied)
    assert len({d for d, _, _ in rows_of(plan)}) == len(photos)


def test_organise_over_many_partitions(spark):
    """A hot folder with every plain name occupied, dealt over many tasks."""
    rng = random.Random(9)
    spread = [(2020 + i % 3, 1 + i % 12, 1, 0, 0, 0) for i in range(30)]
    photos = [(f"dump/{i % 5}/IMG_{rng.randrange(40)}.jpg", JULY if i % 3 == 0 else rng.choice(spread)) for i in range(6000)]
    folders = {f"r/{d[0]:04d}/{d[0]:04d}-{d[1]:02d}" for _, d in photos}
    occupied = {f"{f}/IMG_{k}.jpg" for f in folders for k in range(40)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [d for d, _, _ in rows_of(plan_of(spark, photos, "r", sorted(occupied)))] == organise_brute(photos, "r", occupied)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rewrite_and_selection(spark):
    photos = spark.createDataFrame([(0, "a", True), (1, "a", True), (2, "b", True), (3, "c", False)], "photo_idx long, path string, decoded boolean")
    moved = spark.createDataFrame([("a", "z/a", True), ("b", "z/b", False)], "source string, destination string, ok boolean")
    assert sorted((r["photo_idx"], r["path"]) for r in organize.rewrite_paths(photos, moved).collect()) == [(0, "z/a"), (1, "a"), (2, "b"), (3, "c")]
    marked = spark.createDataFrame([(1,)], "photo_idx long")
    assert sorted(map(tuple, organize.selection_of(photos, marked).collect())) == [(0, 0), (2, 2)]


# Files and scans

def png(pixels):
    """A gray PNG."""
    h, w = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_scan_of_files(spark, tmp_path):
    from tests_support import blurred, noisy, scene

    (tmp_path / "sub dir").mkdir()
    base = scene(128, 128)
    files = {"a one.png": base, "sub dir/b.PNG": noisy(base, 10, 7), "c.png": blurred(base, 1), "wide.png": scene(900, 600, 3)}
    for name, img in files.items():
        (tmp_path / name).write_bytes(png(img))
    (tmp_path / "broken.jpg").write_bytes(b"not an image")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / ".hidden.png").write_bytes(png(base))
    found = images.find_photos(spark, str(tmp_path)).orderBy("photo_idx").collect()
    assert [os.path.basename(r["path"]) for r in found] == ["a one.png", "broken.jpg", "c.png", "b.PNG", "wide.png"]
    assert [r["photo_idx"] for r in found] == list(range(5)) and found[1]["file_size"] == 12
    local = images.find_local_photos(spark, str(tmp_path)).orderBy("photo_idx").collect()
    assert [os.path.basename(r["path"]) for r in local] == [".hidden.png", "a one.png", "broken.jpg", "c.png", "b.PNG", "wide.png"]
    assert images.find_local_photos(spark, str(tmp_path / "none")).collect() == []

    result = library.scan_library(spark, str(tmp_path), 5)
    photos = {os.path.basename(r["path"]): r for r in result.photos.collect()}
    assert (photos["wide.png"]["width"], photos["wide.png"]["height"]) == (900, 600) and not photos["broken.jpg"]["decoded"]
    assert photos["a one.png"]["hash"] == 0x0C0C00 and photos["a one.png"]["sharpness"] == pytest.approx(518.692744)
    assert lists(result.memberships) == [[0, 2, 3]]
    assert {tuple(r) for r in result.keepers().collect()} == {(0, 3)}
    summary = result.summary().first()
    assert summary["summary"] == f"5 photos scanned  ·  1 could not be read  ·  1 groups covering 3 photos  ·  2 ticked for removal  ·  {summary['comparisons']} of 6 possible comparisons evaluated"
    with pytest.raises(ValueError):
        library.scan_library(spark, "")


def test_fake_source_and_own_decoder(spark):
    from tests_support import scene

    from nearkin.functions.raster import np_difference_hash

    base = scene(64, 64)
    rasters = spark.createDataFrame([("p0", 64, 64, [int(x) for x in base.reshape(-1)], JULY, 4000, 3000), ("p1", 64, 64, [1], None, None, None)], f"path string, width int, height int, pixels array<int>, date {DATE}, full_width int, full_height int")
    paths = spark.createDataFrame([("p0", 1, 0), ("p1", 1, 1), ("p2", 1, 2)], "path string, file_size long, photo_idx long")
    got = images.photos_from_rasters(paths, rasters).orderBy("photo_idx").collect()
    assert [r["decoded"] for r in got] == [True, False, False]
    assert (got[0]["hash"], got[0]["width"], got[0]["date"]["month"]) == (np_difference_hash(base), 4000, 7)
    content = spark.createDataFrame([("p0", bytearray(base.tobytes())), ("p1", bytearray(b"zz"))], "path string, content binary")
    decode = lambda path, data: (np.frombuffer(data, np.uint8).reshape(64, 64), 64, 64) if len(data) == 4096 else None
    got = images.photos_with(paths, content, decode).orderBy("photo_idx").collect()
    assert [(r["decoded"], r["hash"]) for r in got] == [(True, np_difference_hash(base)), (False, 0), (False, 0)]
    small = images.thumbnails(paths, content, decode, 16).collect()
    assert [(r["photo_idx"], r["width"], r["height"], len(r["pixels"])) for r in small] == [(0, 16, 16, 256)]
    result = library.scan_photos(images.photos_from_rasters(paths, rasters))
    assert result.memberships.collect() == [] and tuple(result.stats.first()) == (0, 0)


def test_orientation_and_luma():
    img = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert images.upright(img, 6).tolist() == [[3, 0], [4, 1], [5, 2]]
    assert images.upright(img, 8).tolist() == [[2, 5], [1, 4], [0, 3]]
    assert images.upright(img, 3).tolist() == [[5, 4, 3], [2, 1, 0]]
    assert images.to_gray(bytes([10, 20, 30]), 1, 1, 3).tolist() == [[(11 * 30 + 16 * 20 + 5 * 10) // 32]]
    assert images.fit(np.zeros((600, 900), np.uint8)).shape == (171, 256) and images.fit(img).shape == (2, 3)
    scene_ = np.random.default_rng(1).integers(0, 255, (40, 60)).astype(np.uint8)
    assert images.oriented_hashes(scene_)[5] == images.np_difference_hash(images.upright(scene_, 6))
    assert {round(images.np_laplacian_variance(images.upright(scene_, k)), 6) for k in range(1, 9)} == {round(images.np_laplacian_variance(scene_), 6)}
    assert images.thumbnail(img).shape == (88, 132) and images.thumbnail(np.zeros((600, 300), np.uint8)).shape == (132, 66)


def test_actions(spark, tmp_path):
    for name in ("a.jpg", "b.jpg"):
        (tmp_path / name).write_text(name)
    plan = spark.createDataFrame([(0, str(tmp_path / "a.jpg"), str(tmp_path / "2026" / "a.jpg"), "move"), (1, str(tmp_path / "gone.jpg"), str(tmp_path / "2026" / "g.jpg"), "move"), (2, "x", "x", "unchanged")], "pos long, source string, destination string, action string")
    with pytest.raises(ValueError):
        actions.apply_moves(plan)
    done = actions.apply_moves(plan, confirm=True)
    assert [r["ok"] for r in done.collect()] == [True, False] and (tmp_path / "2026" / "a.jpg").read_text() == "a.jpg"
    assert tuple(actions.move_counts(done).first()) == (1, 1)
    assert tuple(actions.failure_text(done).first()) == (1, str(tmp_path / "gone.jpg"))
    photos = spark.createDataFrame([(7, str(tmp_path / "b.jpg"))], "photo_idx long, path string")
    trash = actions.trash_plan(photos, photos, str(tmp_path / "trash"))
    with pytest.raises(ValueError):
        actions.move_to_trash(trash)
    assert actions.move_to_trash(trash, confirm=True).first()["ok"] and (tmp_path / "trash" / "7-b.jpg").exists()


def test_progress():
    for total in (1, 50, 199, 1000, 12345):
        due = [d for d in range(1, total + 1) if library.progress_due(d, total)]
        assert due[-1] == total and len(due) <= 401
    assert [d for d in range(1, 51) if library.progress_due(d, 50)] == list(range(1, 51))


def test_cancel_and_progress(spark):
    assert library.progress(spark) == (0, 0)
    failed = []

    def work():
        with library.tagged(spark, "scan-1"):
            try:
                spark.range(0, 10**13, 1, 4).selectExpr("sum(id * id % 7)").collect()
            except Exception as e:
                failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(100):
        time.sleep(0.1)
        if library.progress(spark)[1]:
            break
    with pytest.raises(ValueError), library.tagged(spark, "scan-1"):
        pass
    while thread.is_alive():
        library.cancel(spark, "scan-1")
        thread.join(0.5)
    assert failed
