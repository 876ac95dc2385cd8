"""Queries over the test tables, one per operator, and their SQL for DuckDB.

The tables hold no photos, so stand-ins are used: embeddings are 8 by 8 rasters or files of their bytes, the signature of a
document is its hash, its number of distinct words its sharpness and its length its area; orders
are dated photos whose names repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions import bits, exif, exif_writer, paths, raster, scenes
from nearkin.functions.exif_writer import Entry
from nearkin.functions.signature import cell_signatures, text_cells, text_signatures
from nearkin.operators import keeper, neardup, organize, ranks
from nearkin.plans import actions, resume
from nearkin.plans.library import PRESETS, ScanResult, scan_photos
from nearkin.runtime import cut, new_folder, ship, spread
from nearkin.sources import datasource, images

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Documents shorter than this stand for photos that cannot be decoded.
LEAST_CHARS = 300


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


# Rasters

PIXELS = "transform(embedding, e -> cast(least(255D, greatest(0D, floor((cast(e AS double) + 1) * 127.5D))) AS int))"
PIXELS_SQL = "SELECT vec_id, list_transform(embedding, lambda e: least(255, greatest(0, floor((e::DOUBLE + 1) * 127.5)))::INT) AS p FROM embeddings"


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr(PIXELS).alias("p"))


def box_sql(w: int, h: int, px: str = PIXELS_SQL) -> str:
    return f"""
px AS ({px}),
cell AS (
  SELECT i, (i // {w}) * 8 // {h} AS y0, least(8, greatest((i // {w}) * 8 // {h} + 1, (i // {w} + 1) * 8 // {h})) AS y1,
         (i % {w}) * 8 // {w} AS x0, least(8, greatest((i % {w}) * 8 // {w} + 1, (i % {w} + 1) * 8 // {w})) AS x1 FROM range({w * h}) t(i)),
one AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, p[k + 1] AS v FROM px, range(64) t(k)),
grid AS (SELECT vec_id, i, (sum(v) // count(*))::INT AS v FROM one JOIN cell ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL)"""


BIT_SUM = "coalesce(sum(CASE WHEN b < 63 THEN pow(2, b)::HUGEINT WHEN b = 63 THEN -(pow(2, 63)::HUGEINT) END), 0)::BIGINT"


def dhash_sql(px: str = PIXELS_SQL) -> str:
    return f"""
{box_sql(9, 8, px)},
bit AS (SELECT l.vec_id, b FROM range(64) t(b) JOIN grid l ON l.i = b // 8 * 9 + b % 8 JOIN grid r ON r.vec_id = l.vec_id AND r.i = l.i + 1 WHERE l.v > r.v),
dhash AS (SELECT e.vec_id, {BIT_SUM} AS hash FROM px e LEFT JOIN bit USING (vec_id) GROUP BY e.vec_id)"""


DHASH_SQL = f"WITH {dhash_sql()}"


@query("box_downscale", f"WITH {box_sql(5, 3)} SELECT vec_id, i, v FROM grid")
def box_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("vec_id", F.posexplode(raster.box_downscale("p", "8", "8", 5, 3)).alias("i", "v"))


@query("box_upscale", f"WITH {box_sql(9, 8)} SELECT vec_id, i, v FROM grid")
def box_upscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("vec_id", F.posexplode(raster.box_downscale("p", "8", "8", 9, 8)).alias("i", "v"))


def dhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("vec_id", raster.difference_hash("p", "8", "8").alias("hash"))


@query("difference_hash", f"{DHASH_SQL} SELECT vec_id, hash FROM dhash")
def difference_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dhashes(spark, sf_dir)


LAPLACIAN_SQL = """
r AS (
  SELECT vec_id, p[k - 7] + p[k + 9] + p[k] + p[k + 2] - 4 * p[k + 1] AS r FROM px, range(64) t(k)
  WHERE k // 8 BETWEEN 1 AND 6 AND k % 8 BETWEEN 1 AND 6),
s AS (SELECT vec_id, sum(r)::DOUBLE AS s, sum(r * r)::DOUBLE AS q, count(*) AS n FROM r GROUP BY vec_id),
sharp AS (SELECT vec_id, round(greatest(0, q / n - (s / n) * (s / n)), 6) AS sharpness FROM s)"""


@query("laplacian_variance", f"WITH px AS ({PIXELS_SQL}), {LAPLACIAN_SQL} SELECT * FROM sharp")
def laplacian_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("vec_id", F.round(raster.laplacian_variance("p", "8", "8"), 6).alias("sharpness"))


@query("popcount", f"{DHASH_SQL} SELECT vec_id, bit_count(hash)::INT AS bits FROM dhash")
def popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dhashes(spark, sf_dir).select("vec_id", bits.popcount(F.col("hash")).alias("bits"))


NEXT_SQL = f"{DHASH_SQL}, pair AS (SELECT a.vec_id, bit_count(xor(a.hash, b.hash))::INT AS distance FROM dhash a JOIN dhash b ON b.vec_id = a.vec_id + 1)"


def next_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = dhashes(spark, sf_dir)
    a, b = h.select("vec_id", "hash"), h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("other"))
    return a.join(b, "vec_id").select("vec_id", bits.hamming(F.col("hash"), F.col("other")).alias("distance"))


@query("hamming_distance", f"{NEXT_SQL} SELECT vec_id, distance FROM pair")
def hamming_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_distances(spark, sf_dir)


@query("hamming_topk", f"{NEXT_SQL} SELECT vec_id, distance FROM pair ORDER BY distance, vec_id LIMIT 20")
def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty neighbours that are nearest: a report, so the limit is what is asked for."""
    return next_distances(spark, sf_dir).orderBy("distance", "vec_id").limit(20)


@query("band_values", f"{DHASH_SQL} SELECT vec_id, b::INT AS band, ((hash >> (8 * b)::INT) & 255) AS band_value FROM dhash, range(8) t(b)")
def band_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.band_index(neardup.hashed(dhashes(spark, sf_dir), "vec_id"))
    return rows.select(F.col("idx").alias("vec_id"), "band", "band_value")


#: A frame of each raster with noise of its own, and that frame out of focus: the sequence step by step.
FRAMES_SQL = f"""
WITH RECURSIVE px AS ({PIXELS_SQL}),
s AS (SELECT vec_id, 0 AS i, vec_id::HUGEINT AS state FROM px UNION ALL SELECT vec_id, i + 1, (state * 1664525 + 1013904223) % 4294967296 FROM s WHERE i < 64),
f AS (SELECT vec_id, i - 1 AS i, greatest(0, least(255, p[i] + ((state // 65536) % 25 - 12)))::INT AS v FROM s JOIN px USING (vec_id) WHERE i > 0),
a AS (SELECT vec_id, list(v ORDER BY i) AS q FROM f GROUP BY vec_id)
SELECT vec_id, i::INT AS i, v, CASE WHEN i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6 THEN (v + q[i] + q[i + 2] + q[i - 7] + q[i + 9]) // 5 ELSE v END AS soft
FROM f JOIN a USING (vec_id)"""


@query("second_frames", FRAMES_SQL)
def second_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = rasters(spark, sf_dir).select("vec_id", scenes.noisy(F.col("p"), 64, 12, F.col("vec_id")).alias("v"))
    both = F.arrays_zip("v", scenes.blurred(F.col("v"), 8, 8).alias("soft"))
    return noise.select("vec_id", F.posexplode(both).alias("i", "x")).select("vec_id", "i", "x.v", "x.soft")


# Groups of documents

SIGNATURE_SQL = f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^ \\n]+')) AS t FROM documents),
cnt AS (SELECT doc_id, ('0x' || left(md5(t), 4))::INT % 72 AS c, count(*) AS n FROM tok GROUP BY ALL),
bit AS (
  SELECT l.doc_id, b FROM range(64) x(b) JOIN cnt l ON l.c = b // 8 * 9 + b % 8 LEFT JOIN cnt r ON r.doc_id = l.doc_id AND r.c = l.c + 1
  WHERE l.n > coalesce(r.n, 0)),
sig AS (SELECT d.doc_id AS idx, {BIT_SUM} AS hash FROM documents d LEFT JOIN bit USING (doc_id) GROUP BY d.doc_id),
photo AS (
  SELECT idx, hash, n_chars >= {LEAST_CHARS} AS decoded, n_chars AS width, 1 AS height,
         len(list_distinct(regexp_extract_all(lower(text), '[^ \\n]+'))) AS sharpness
  FROM sig JOIN documents ON doc_id = idx)"""


def near_sql(threshold: int, source: str = "sig") -> str:
    """CTEs: pairs of a source within a threshold, by brute force, and the groups they form."""
    return f"""
near AS (SELECT a.idx AS a, b.idx AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM {source} a JOIN {source} b ON a.idx < b.idx AND bit_count(xor(a.hash, b.hash)) <= {threshold}),
edge AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a AS idx, a AS r FROM edge UNION SELECT reach.idx, edge.b FROM reach JOIN edge ON edge.a = reach.r),
member AS (SELECT min(r) AS group_id, idx FROM reach GROUP BY idx)"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_signatures(table(spark, sf_dir, "documents")).select(F.col("id").alias("idx"), "hash")


@query("text_signature", f"WITH {SIGNATURE_SQL} SELECT idx, hash FROM sig")
def text_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(spark, sf_dir)


@query("band_candidates", f"""
WITH {SIGNATURE_SQL}
SELECT a.idx AS a, b.idx AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM sig a JOIN sig b ON a.idx < b.idx AND (
  {' OR '.join(f'((a.hash >> {8 * k}) & 255) = ((b.hash >> {8 * k}) & 255)' for k in range(8))})""")
def band_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.band_candidates(cut(signatures(spark, sf_dir)))


@query("candidate_stats", f"""
WITH {SIGNATURE_SQL}
SELECT count(*) FILTER ({' OR '.join(f'((a.hash >> {8 * k}) & 255) = ((b.hash >> {8 * k}) & 255)' for k in range(8))}) AS comparisons, count(*) AS naive_comparisons
FROM sig a JOIN sig b ON a.idx < b.idx""")
def candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.candidate_stats(cut(signatures(spark, sf_dir)))


def _pairs(threshold: int) -> Query:
    return lambda spark, sf_dir: neardup.near_pairs(cut(signatures(spark, sf_dir)), threshold)


for _t in (1, 3, 5, 7):
    query(f"near_dup_pairs_t{_t}", f"WITH RECURSIVE {SIGNATURE_SQL}, {near_sql(_t)} SELECT a, b, distance FROM near")(_pairs(_t))


@query("threshold_clamp", f"WITH RECURSIVE {SIGNATURE_SQL}, {near_sql(7)} SELECT a, b, distance FROM near")
def threshold_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(cut(signatures(spark, sf_dir)), 99)


def _groups(threshold: int) -> Query:
    return lambda spark, sf_dir: neardup.near_groups(cut(signatures(spark, sf_dir)), threshold)


for _t in (1, 3, 5, 7):
    query(f"near_dup_groups_t{_t}", f"WITH RECURSIVE {SIGNATURE_SQL}, {near_sql(_t)} SELECT group_id, idx FROM member")(_groups(_t))


@query("group_lists", f"WITH RECURSIVE {SIGNATURE_SQL}, {near_sql(3)} SELECT group_id, string_agg(idx, ',' ORDER BY idx) AS members FROM member GROUP BY group_id")
def group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = neardup.group_lists(_groups(3)(spark, sf_dir))
    return lists.select("group_id", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


@query("group_order", f"WITH RECURSIVE {SIGNATURE_SQL}, {near_sql(3)} SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS place FROM member GROUP BY group_id")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order of their first members."""
    return ranks.numbered(_groups(3)(spark, sf_dir).select("group_id").distinct(), F.col("group_id").asc(), "place")


@query("group_sizes", f"WITH RECURSIVE {SIGNATURE_SQL}, {near_sql(3)} SELECT group_id, count(*) AS size, count(*) - 1 AS to_remove FROM member GROUP BY group_id")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeper.group_sizes(_groups(3)(spark, sf_dir))


@query("group_label", f"""
WITH RECURSIVE {SIGNATURE_SQL}, {near_sql(3)}, s AS (SELECT group_id, count(*) AS n FROM member GROUP BY group_id)
SELECT group_id, format('{paths.GROUP_LABEL.replace("%d", "{}")}', group_id, n, n - 1) AS label FROM s""")
def group_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = keeper.group_sizes(_groups(3)(spark, sf_dir))
    return sizes.select("group_id", paths.group_label(F.col("group_id"), F.col("size")).alias("label"))


# Scans

def scan(spark: SparkSession, sf_dir: str) -> ScanResult:
    docs = table(spark, sf_dir, "documents")
    signed = cell_signatures(text_cells(docs, kept=("n_chars",)), "words", "n_chars")
    return scan_photos(signed.select(F.col("id").alias("photo_idx"), "hash", F.col("words").alias("sharpness"), F.col("n_chars").alias("width"), F.lit(1).alias("height"), (F.col("n_chars") >= LEAST_CHARS).alias("decoded")))


SCAN_SQL = f"""WITH RECURSIVE {SIGNATURE_SQL}, good AS (SELECT * FROM photo WHERE decoded), {near_sql(3, "good")},
best AS (SELECT group_id, idx AS keeper FROM member JOIN photo USING (idx) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY sharpness DESC, width * height DESC, idx) = 1)"""


@query("failed_excluded", f"{SCAN_SQL} SELECT group_id, idx FROM member")
def failed_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).memberships


@query("keeper_per_group", f"{SCAN_SQL} SELECT group_id, keeper FROM best")
def keeper_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).keepers()


@query("removal_marks", f"{SCAN_SQL} SELECT group_id, idx FROM member JOIN best USING (group_id) WHERE idx <> keeper")
def removal_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).removal_marks()


@query("scan_summary", f"""{SCAN_SQL},
s AS (
  SELECT (SELECT count(*) FROM photo) AS photos, (SELECT count(*) FROM photo WHERE NOT decoded) AS failed, (SELECT count(DISTINCT group_id) FROM member) AS groups,
         (SELECT count(*) FROM member) AS in_groups,
         (SELECT count(*) FROM good a JOIN good b ON a.idx < b.idx AND ({' OR '.join(f'((a.hash >> {8 * k}) & 255) = ((b.hash >> {8 * k}) & 255)' for k in range(8))})) AS comparisons,
         (SELECT count(*) * (count(*) - 1) // 2 FROM good) AS naive_comparisons)
SELECT *, in_groups - groups AS marked,
       concat_ws('  ·  ', photos || ' photos scanned', CASE WHEN failed > 0 THEN failed || ' could not be read' END, groups || ' groups covering ' || in_groups || ' photos',
       (in_groups - groups) || ' ticked for removal', CASE WHEN naive_comparisons > 0 THEN comparisons || ' of ' || naive_comparisons || ' possible comparisons evaluated' END) AS summary
FROM s""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).summary()


@query("regroup_after_delete", f"""{SCAN_SQL},
left_ AS (SELECT * FROM member WHERE idx % 3 <> 0),
ok AS (SELECT group_id, min(idx) AS new_id FROM left_ GROUP BY group_id HAVING count(*) >= 2)
SELECT new_id AS group_id, idx FROM left_ JOIN ok USING (group_id)""")
def regroup_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member whose number is divisible by three is removed."""
    members = scan(spark, sf_dir).memberships
    return keeper.regroup(members, members.filter("idx % 3 = 0"))


# Photos: embeddings are files of 64 gray bytes, of which every ninth has lost its last byte and cannot be decoded

def square(path: str, content: bytes) -> tuple[np.ndarray, int, int] | None:
    """The decoder of these files."""
    return (np.frombuffer(content, np.uint8).reshape(8, 8), 8, 8) if len(content) == 64 else None


def square_files(rows: DataFrame) -> DataFrame:
    """(photo_idx, path, file_size, p, content) from (vec_id, p)."""
    kept = F.expr("if(vec_id % 9 = 0, slice(p, 1, 63), p)")
    files = rows.select(F.col("vec_id").alias("photo_idx"), F.format_string("/dump/%d.gray", "vec_id").alias("path"), kept.alias("p"))
    content = F.unhex(F.array_join(F.transform("p", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return files.select("photo_idx", "path", F.size("p").cast("long").alias("file_size"), "p", content.alias("content"))


def _seen(photos: DataFrame) -> DataFrame:
    return photos.select("photo_idx", "file_size", "hash", F.round("sharpness", 6).alias("sharpness"), "width", "height", "decoded")


SEEN_SQL = f"""{DHASH_SQL}, {LAPLACIAN_SQL}
SELECT vec_id AS photo_idx, CASE WHEN ok THEN 64 ELSE 63 END::BIGINT AS file_size, CASE WHEN ok THEN hash ELSE 0 END AS hash, CASE WHEN ok THEN sharpness ELSE 0 END AS sharpness,
       CASE WHEN ok THEN 8 ELSE 0 END AS width, CASE WHEN ok THEN 8 ELSE 0 END AS height, ok AS decoded
FROM (SELECT *, vec_id % 9 <> 0 AS ok FROM dhash JOIN sharp USING (vec_id))"""


def raster_photos(rows: DataFrame) -> DataFrame:
    files = square_files(rows)
    held = files.select("path", F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("p").alias("pixels"), F.lit(None).cast(exif.DATE_TYPE).alias("date"),
                        F.lit(None).cast("int").alias("full_width"), F.lit(None).cast("int").alias("full_height"))
    return images.photos_from_rasters(files.select("photo_idx", "path", "file_size"), held)


@query("photos_in_memory", SEEN_SQL)
def photos_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(raster_photos(rasters(spark, sf_dir)))


@query("photos_own_decoder", SEEN_SQL)
def photos_own_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = square_files(rasters(spark, sf_dir))
    return _seen(images.photos_with(files.select("photo_idx", "path", "file_size"), files, square))


@query("photos_format", f"SELECT '/dump/' || photo_idx || '.gray' AS path, * EXCLUDE photo_idx FROM ({SEEN_SQL})")
def photos_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, packed into a table of contents, through the data source of photos."""
    folder = new_folder(spark, "packed")
    square_files(rasters(spark, sf_dir)).select("path", "content").write.parquet(folder)
    found = datasource.register(spark).read.format("photos").option("decoder", f"{__name__}:square").option("packed", "true").load(folder)
    return found.select("path", "file_size", "hash", F.round("sharpness", 6).alias("sharpness"), "width", "height", "decoded")


#: Each raster and a copy with a white corner.
RETOUCHED_SQL = f"SELECT 2 * vec_id + c AS vec_id, CASE c WHEN 1 THEN list_concat([255], p[2:]) ELSE p END AS p FROM ({PIXELS_SQL}), range(2) t(c)"


@query("scan_photos_t5", f"WITH RECURSIVE {dhash_sql(RETOUCHED_SQL)}, good AS (SELECT vec_id AS idx, hash FROM dhash WHERE vec_id % 9 <> 0), {near_sql(5, 'good')} SELECT group_id, idx FROM member")
def scan_photos_t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_photos(raster_photos(retouched(spark, sf_dir)), PRESETS["loose"]).memberships


@query("thumbnails", f"WITH {box_sql(12, 12)} SELECT vec_id AS photo_idx, i, v FROM grid WHERE vec_id % 9 <> 0")
def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = square_files(rasters(spark, sf_dir))
    small = images.thumbnails(files.select("photo_idx", "path"), files, square, 12)
    return small.select("photo_idx", F.posexplode(F.expr("transform(sequence(1, width * height), i -> cast(conv(hex(substring(pixels, i, 1)), 16, 10) AS int))")).alias("i", "v"))


def each_raster(spark: SparkSession, sf_dir: str, values: Callable[[np.ndarray], Iterable[int]]) -> DataFrame:
    """(vec_id, i, v): the numbers that a function of arrays gives for each raster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": [[int(v) for v in values(np.asarray(p, np.uint8).reshape(8, 8))] for p in batch["p"]]})

    return rasters(spark, sf_dir).mapInPandas(run, "vec_id long, v array<long>").select("vec_id", F.posexplode("v").alias("i", "v"))


@query("scaled_decode", f"WITH {box_sql(5, 5)} SELECT vec_id, i, v::BIGINT AS v FROM grid")
def scaled_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_raster(spark, sf_dir, lambda gray: images.fit(gray, 5).reshape(-1))


@query("gray_luma", f"""
SELECT vec_id, i::INT AS i, ((11 * p[3 * i + 3] + 16 * p[3 * i + 2] + 5 * p[3 * i + 1]) // 32)::BIGINT AS v FROM ({PIXELS_SQL}), range(21) t(i)""")
def gray_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 63 bytes as three rows of seven pixels: blue, green, red."""
    return each_raster(spark, sf_dir, lambda gray: images.to_gray(gray.tobytes()[:63], 7, 3, 3).reshape(-1))


#: The place in the stored raster of pixel (y, x) of the upright one, for orientations 1 to 8.
UPRIGHT_SQL = ("8 * y + x", "8 * y + 7 - x", "8 * (7 - y) + 7 - x", "8 * (7 - y) + x", "8 * x + y", "8 * (7 - x) + y", "8 * (7 - x) + 7 - y", "8 * x + 7 - y")
TURNED_SQL = f"""
SELECT 8 * vec_id + o AS vec_id, list(p[(CASE o {' '.join(f'WHEN {o} THEN {at}' for o, at in enumerate(UPRIGHT_SQL))} END) + 1] ORDER BY y, x) AS p
FROM ({PIXELS_SQL}), range(8) a(o), range(8) b(y), range(8) c(x) GROUP BY vec_id, o"""


@query("oriented_hashes", f"WITH {dhash_sql(TURNED_SQL)} SELECT vec_id // 8 AS vec_id, (vec_id % 8)::INT AS i, hash AS v FROM dhash")
def oriented_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_raster(spark, sf_dir, images.oriented_hashes)


#: Photos of one batch of a scan that is cancelled and resumed; most jobs that one is resumed in.
BATCH, STEPS = 100, 8


def in_batches(spark: SparkSession, sf_dir: str, rows: DataFrame, folder: str, keep: int | None = None, steps: int | None = None) -> ScanResult:
    """A scan of rasters by batches, or in so many steps of several; with ``keep`` it is cancelled after so many of them."""
    found = rows.select(F.col("vec_id").alias("photo_idx"), F.format_string("/dump/%d.gray", "vec_id").alias("path"), F.when(F.col("vec_id") % 9 == 0, 63).otherwise(64).cast("long").alias("file_size"))
    # only the rows of a batch are read as photos
    decode = lambda batch: raster_photos(rows.join(batch.select(F.col("photo_idx").alias("vec_id")), "vec_id", "left_semi"))
    done: list[int] = []
    stop = lambda: keep is not None and len(done) >= keep
    return resume.scan_batches(found, decode, folder, PRESETS["loose"], BATCH, steps, cancelled=stop, on_batch=lambda p: done.append(p.done))


def retouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.expr("inline(array(struct(2 * vec_id AS vec_id, p), struct(2 * vec_id + 1 AS vec_id, concat(array(255), slice(p, 2, 63)) AS p)))")
    return rasters(spark, sf_dir).select(both)


@query("scan_cancelled", f"SELECT * FROM ({SEEN_SQL}) WHERE photo_idx < {3 * BATCH}")
def scan_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that is cancelled after three batches keeps what it has decoded; the batches are those of the whole table."""
    return _seen(in_batches(spark, sf_dir, rasters(spark, sf_dir), new_folder(spark, "scan"), 3).photos)


@query("scan_resumed", f"WITH RECURSIVE {dhash_sql(RETOUCHED_SQL)}, good AS (SELECT vec_id AS idx, hash FROM dhash WHERE vec_id % 9 <> 0), {near_sql(5, 'good')} SELECT group_id, idx FROM member")
def scan_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that is cancelled after two steps and taken up again gives the groups of one scan."""
    rows, folder = cut(retouched(spark, sf_dir)), new_folder(spark, "scan")
    in_batches(spark, sf_dir, rows, folder, 2, STEPS)
    return in_batches(spark, sf_dir, rows, folder, steps=STEPS).memberships


# Capture times

def _jpeg(head: str, date: Column) -> Column:
    return F.unhex(F.concat(F.lit(head), F.hex(date), F.lit("00FFD9")))


#: A JPEG of nothing but a capture time, before the 19 characters of it: little- and big-endian.
LITTLE = "FFD8FFE1004845786966000049492A0008000000010069870400010000001A00000000000000010003900200140000002C00000000000000"
BIG = "FFD8FFE100484578696600004D4D002A00000008000187690004000000010000001A00000000000190030002000000140000002C00000000"
PARTS = exif.PARTS


def dated(spark: SparkSession, sf_dir: str, head: str, date: Column | None = None) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss") if date is None else date
    return table(spark, sf_dir, "orders").select("o_orderkey", exif.exif_date(_jpeg(head, text)).alias("date"))


DATE_SQL = "SELECT o_orderkey, {} FROM orders".format(", ".join(f"extract({k} FROM o_orderdate)::INT AS {k}" for k in PARTS))


@query("exif_date_le", DATE_SQL)
def exif_date_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir, LITTLE).select("o_orderkey", *[f"date.{k}" for k in PARTS])


@query("exif_date_be", DATE_SQL)
def exif_date_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir, BIG).select("o_orderkey", *[f"date.{k}" for k in PARTS])


BAD_DATES = ("2026:13:01 10:00:00", "2026:12:32 10:00:00", "2026:12:31 25:00:00", "0000:00:00 00:00:00", "1825:01:01 00:00:00", "2026:02:31 23:59:60")


@query("exif_rejects", "SELECT o_orderkey, o_orderkey % 6 = 5 AS dated FROM orders")
def exif_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these texts only the last one is a date: month lengths are not looked at and second 60 is allowed."""
    text = F.element_at(F.array(*map(F.lit, BAD_DATES)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return dated(spark, sf_dir, LITTLE, text).select("o_orderkey", F.col("date").isNotNull().alias("dated"))


#: Lengths: four entries of the main directory end at 62, the capture directory of two at its values' end.
WRITTEN_SQL = """
WITH v AS (SELECT o_orderkey, o_orderpriority AS make, o_orderstatus AS artist, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS date, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS shown, o_orderkey % 8 + 1 AS turn FROM orders),
l AS (SELECT *, length(make) + 1 AS mc, (length(make) + 2) // 2 * 2 AS ml FROM v),
b AS (
  SELECT *, '4D4D002A00000008' || '0004' || '010F0002' || printf('%08X', mc) || '0000003E' || '01120003' || '00000001' || printf('%04X', turn) || '0000'
    || '013B0002' || '00000002' || hex(artist) || '000000' || '87690004' || '00000001' || printf('%08X', 62 + ml) || '00000000'
    || hex(make) || CASE WHEN mc % 2 = 1 THEN '0000' ELSE '00' END
    || '0002' || '90030002' || '00000014' || printf('%08X', 92 + ml) || '90040002' || '00000014' || printf('%08X', 112 + ml) || '00000000' || hex(date) || '00' || hex(shown) || '00' AS tiff FROM l)
SELECT o_orderkey, 'FFD8FFE1' || printf('%04X', length(tiff) // 2 + 8) || '457869660000' || tiff || 'FFD9' AS jpeg, replace(date[:10], ':', '-') || date[11:] AS taken, turn::INT AS turn FROM b"""


@query("exif_write", WRITTEN_SQL)
def exif_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with texts of different lengths in both directories, written big-endian, and read back."""
    date = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    turn = (F.col("o_orderkey") % 8 + 1).cast("int")
    main = [Entry(0x010F, exif_writer.ASCII, F.col("o_orderpriority")), Entry(0x013B, exif_writer.ASCII, F.col("o_orderstatus")), Entry(exif.TAG_ORIENTATION, exif_writer.SHORT, turn)]
    capture = [Entry(exif.TAG_ORIGINAL, exif_writer.ASCII, date), Entry(exif.TAG_DIGITIZED, exif_writer.ASCII, date)]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", exif_writer.exif_jpeg(main, capture, little=False).alias("data"))
    tags = images._tags("data")
    taken = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *[tags[k] for k in PARTS])
    return rows.select("o_orderkey", F.hex("data").alias("jpeg"), taken.alias("taken"), tags["orientation"].alias("turn"))


@query("format_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown FROM orders")
def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir, LITTLE).select("o_orderkey", exif.format_date(F.col("date")).alias("shown"))


# Paths

NAME_SQL = r"SELECT page_id, url, regexp_extract(url, '([^/\\]*)$', 1) AS name FROM pages"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.file_name(F.col("url")).alias("name"))


@query("file_name_of", f"SELECT page_id, name FROM ({NAME_SQL})")
def file_name_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir)


@query("split_extension", f"""
SELECT page_id, CASE WHEN d > 1 THEN left(name, d - 1) ELSE name END AS stem, CASE WHEN d > 1 THEN substr(name, d) ELSE '' END AS extension
FROM (SELECT page_id, name || '.v1.html' AS name, length(name || '.v1.html') - strpos(reverse(name || '.v1.html'), '.') + 1 AS d FROM ({NAME_SQL}))""")
def split_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("name", F.lit(".v1.html"))
    return names(spark, sf_dir).select("page_id", paths.stem(name).alias("stem"), paths.extension(name).alias("extension"))


ENDINGS = (".jpg", ".JPEG", ".png", ".Bmp", ".webp", ".tif", ".tiff", ".gif", ".heic", "jpg", "")


@query("photo_extension_filter", f"""
SELECT page_id, path FROM (SELECT page_id, url || ({list(ENDINGS)})[page_id % {len(ENDINGS)} + 1] AS path FROM pages)
WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|webp|tif)$')""")
def photo_extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", ending).alias("path"))
    return rows.filter(paths.has_photo_extension(F.col("path")))


ROOTS = ("/photos", "/photos/", "D:\\\\Photos\\\\", "/", "//", "relative///")


@query("trim_root", rf"""
SELECT o_orderkey, regexp_replace((['/photos', '/photos/', 'D:\Photos\', '/', '//', 'relative///'])[o_orderkey % 6 + 1], '^(.+?)[/\\]+$', '\1') AS root FROM orders""")
def trim_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = F.array(*[F.lit(r.replace("\\\\", "\\")) for r in ROOTS])
    root = F.element_at(roots, (F.col("o_orderkey") % len(ROOTS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", paths.trim_root(root).alias("root"))


FOLDER_SQL = "CASE WHEN o_orderstatus = 'P' THEN '/photos/Undated' ELSE '/photos/' || strftime(o_orderdate, '%Y/%Y-%m') END"


@query("destination_folder", f"SELECT o_orderkey, {FOLDER_SQL} AS folder FROM orders")
def destination_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_photos(spark, sf_dir)
    return rows.select(F.col("photo_idx").alias("o_orderkey"), paths.destination_folder(F.lit("/photos/"), F.col("date.year"), F.col("date.month")).alias("folder"))


@query("human_size", """
SELECT o_orderkey, CASE WHEN s >= 1048576 THEN printf('%.1f MB', s / 1048576.0) ELSE printf('%d KB', round_even(s / 1024.0, 0)::BIGINT) END AS size
FROM (SELECT o_orderkey, o_orderkey * 997 AS s FROM orders)""")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", paths.human_size(F.col("o_orderkey") * 997).alias("size"))


@query("photo_label", """
SELECT o_orderkey, concat_ws(chr(10), 'IMG_' || o_orderkey % 97 || '.jpg', '640 x 480  ·  1 KB', CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END,
       CASE WHEN o_orderkey % 2 = 0 THEN '★ sharpest — keep' END) AS label FROM orders""")
def photo_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_photos(spark, sf_dir)
    label = paths.photo_label(paths.file_name(F.col("path")), F.lit(640), F.lit(480), F.lit(1024), exif.format_date(F.col("date")), F.col("photo_idx") % 2 == 0)
    return rows.select(F.col("photo_idx").alias("o_orderkey"), label.alias("label"))


# Organise plans

def order_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.struct(*[F.expr(f"cast(extract({k} FROM o_orderdate) AS int)").alias(k) for k in PARTS])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("photo_idx"), F.format_string("/dump/IMG_%d.jpg", F.col("o_orderkey") % 97).alias("path"), F.when(F.col("o_orderstatus") != "P", date).alias("date"), F.lit(True).alias("decoded"))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = order_photos(spark, sf_dir)
    return organize.organise_plan(photos, organize.selection_of(photos), "/photos/")


PLAN_SQL = f"""
WITH r AS (SELECT o_orderkey AS pos, '/dump/IMG_' || o_orderkey % 97 || '.jpg' AS source, {FOLDER_SQL} AS folder, o_orderstatus = 'P' AS undated FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, source ORDER BY pos) AS k FROM r),
plan AS (
  SELECT pos, pos AS photo_idx, source, undated,
         folder || '/' || CASE WHEN k = 1 THEN substr(source, 7) ELSE replace(substr(source, 7), '.jpg', '') || ' (' || k || ').jpg' END AS destination, 'move' AS action
  FROM n)"""


@query("organize_plan", f"{PLAN_SQL} SELECT * FROM plan")
def organize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir)


@query("organize_counts", f"""
WITH r AS (SELECT o_orderkey % 7 = 0 AS there, o_orderstatus = 'P' AS undated FROM orders)
SELECT count(*) FILTER (NOT there) AS moves, count(*) FILTER (undated) AS undated, count(*) FILTER (there) AS unchanged FROM r""")
def organize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos whose number is divisible by seven are where the plan puts them."""
    photos = order_photos(spark, sf_dir)
    name = F.format_string("/IMG_%d.jpg", "photo_idx")
    home = paths.destination_folder(F.lit("/photos/"), F.col("date.year"), F.col("date.month"))
    photos = photos.withColumn("path", F.concat(F.when(F.col("photo_idx") % 7 == 0, home).otherwise("/dump"), name))
    return organize.organise_counts(organize.organise_plan(photos, organize.selection_of(photos), "/photos/"))


@query("organize_occupied", f"""{PLAN_SQL}
SELECT pos, source, regexp_replace(destination, ' \\(\\d+\\)', '') AS folder_name, k + 1 AS number
FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(destination, ' \\(\\d+\\)', '') ORDER BY pos) AS k FROM plan)""")
def organize_occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plain name is occupied, so numbers start at two."""
    photos = order_photos(spark, sf_dir)
    folder = paths.destination_folder(F.lit("/photos/"), F.col("date.year"), F.col("date.month"))
    first = cut(photos.select(F.concat_ws("/", folder, paths.file_name(F.col("path"))).alias("path")).distinct())
    out = organize.organise_plan(photos, organize.selection_of(photos), "/photos/", first)
    number = F.regexp_extract("destination", r" \((\d+)\)", 1).cast("long")
    return out.select("pos", "source", F.regexp_replace("destination", r" \(\d+\)", "").alias("folder_name"), number.alias("number"))


#: Of each name some numbers are occupied in each folder, at distances of two to six.
GAPS_SQL = f"""{PLAN_SQL},
family AS (SELECT *, regexp_replace(destination, ' \\(\\d+\\)', '') AS plain, regexp_extract(source, '(\\d+)', 1)::INT % 5 + 2 AS step FROM plan),
free AS (SELECT step, n, row_number() OVER (PARTITION BY step ORDER BY n) AS k FROM range(2, 7) s(step), range(1, 50000) t(n) WHERE n % step <> 1 OR n > 60),
ranked AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY pos) AS k FROM family)
SELECT pos, plain, n AS number FROM ranked JOIN free USING (step, k)"""


@query("organize_gaps", GAPS_SQL)
def organize_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied numbers with gaps: 1, then every second to sixth one up to 60."""
    photos = order_photos(spark, sf_dir)
    plain = plan(spark, sf_dir).select(F.regexp_replace("destination", r" \(\d+\)", "").alias("plain")).distinct()
    step = F.regexp_extract("plain", r"IMG_(\d+)", 1).cast("int") % 5 + 2
    number = F.explode(F.sequence(F.lit(1), F.lit(60), step)).alias("n")
    path = F.when(F.col("n") == 1, F.col("plain")).otherwise(F.regexp_replace("plain", r"\.jpg$", F.concat(F.lit(" ("), "n", F.lit(").jpg"))))
    occupied = cut(plain.select("plain", number).select(path.alias("path")))
    out = organize.organise_plan(photos, organize.selection_of(photos), "/photos/", occupied)
    found = F.regexp_extract("destination", r" \((\d+)\)", 1)
    return out.select("pos", F.regexp_replace("destination", r" \(\d+\)", "").alias("plain"), F.when(found == "", 1).otherwise(found.try_cast("long")).alias("number"))


@query("path_rewrite", f"""{PLAN_SQL},
m AS (SELECT source, min(destination) AS destination FROM plan WHERE pos % 2 = 0 GROUP BY source),
f AS (SELECT source, min(pos) AS pos FROM plan GROUP BY source)
SELECT p.pos AS photo_idx, coalesce(m.destination, p.source) AS path FROM plan p LEFT JOIN f USING (pos) LEFT JOIN m ON m.source = f.source""")
def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of even positions succeed."""
    moved = plan(spark, sf_dir).select("source", "destination", (F.col("pos") % 2 == 0).alias("ok"))
    return organize.rewrite_paths(order_photos(spark, sf_dir), moved).select("photo_idx", "path")


@query("trash_plan", """
SELECT o_orderkey AS photo_idx, '/dump/IMG_' || o_orderkey % 97 || '.jpg' AS source, '/trash/' || o_orderkey || '-IMG_' || o_orderkey % 97 || '.jpg' AS destination
FROM orders WHERE o_orderkey % 5 = 0""")
def trash_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = order_photos(spark, sf_dir)
    return actions.trash_plan(photos, photos.filter("photo_idx % 5 = 0"), "/trash")


@query("organize_selection", "SELECT o_orderkey AS pos, o_orderkey AS photo_idx FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'F'")
def organize_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of status F stand for failures, and those divisible by five are marked."""
    photos = order_photos(spark, sf_dir).drop("decoded").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("photo_idx"), (F.col("o_orderstatus") != "F").alias("decoded")), "photo_idx")
    return organize.selection_of(photos, photos.filter("photo_idx % 5 = 0"))


@query("failure_text", """
WITH f AS (SELECT '/dump/' || o_orderkey || '.jpg' AS source FROM orders WHERE o_orderkey % 7 = 0)
SELECT count(*) AS failures, (SELECT string_agg(source, chr(10) ORDER BY source) FROM (SELECT source FROM f ORDER BY source LIMIT 10)) AS names FROM f""")
def failure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.format_string("/dump/%d.jpg", "o_orderkey").alias("source"), (F.col("o_orderkey") % 7 != 0).alias("ok"))
    return actions.failure_text(rows)


@query("move_counts", "SELECT count(*) FILTER (o_orderkey % 7 <> 0) AS moved, count(*) FILTER (o_orderkey % 7 = 0) AS failed FROM orders")
def move_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.move_counts(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7 != 0).alias("ok")))


@query("path_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_comment, o_orderkey) - 1 AS photo_idx FROM (SELECT o_orderkey, o_orderpriority || '/' || o_orderkey AS o_comment FROM orders)")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos are numbered in the order of their paths."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", "o_orderpriority", "o_orderkey").alias("path"))
    return ranks.numbered(rows, F.col("path").asc(), "photo_idx").select("o_orderkey", "photo_idx")
