"""Near-duplicate pairs and groups of 64-bit hashes within a Hamming distance.

The plain index cuts a hash into eight bands of eight bits: hashes within seven bits of each other
share a band (``band_index``, ``band_candidates``). Its buckets are large at scale, so pairs and
groups come from a finer index with the same answer: the hash is cut into t+f blocks and every f
of them form a key. A pair within t bits leaves at least f blocks alone, so it shares a key, of
about 64f/(t+f) bits; f grows with the table (``free_blocks``), so buckets stay small. Both run on distinct hashes; equal hashes are linked as stars, so a hash
that a third of all rows share never forms its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions.bits import BAND_BITS, BANDS, band_value, clamp_threshold, hamming, signed
from nearkin.operators.components import connected_components
from nearkin.runtime import cut


def hashed(df: DataFrame, idx: str = "idx", hash_col: str = "hash") -> DataFrame:
    return df.select(F.col(idx).alias("idx"), F.col(hash_col).alias("hash"))


def band_index(hashes: DataFrame) -> DataFrame:
    """(idx, hash, band, band_value): a row for each band of each hash."""
    bands = F.array(*[F.struct(F.lit(b).alias("band"), band_value(F.col("hash"), b).alias("band_value")) for b in range(BANDS)])
    return hashes.select("idx", "hash", F.inline(bands))


def _lowest_common_band(a: Column, b: Column) -> Column:
    differ = a.bitwiseXOR(b)
    return F.coalesce(*[F.when(band_value(differ, k) == 0, F.lit(k)) for k in range(BANDS)])


def band_candidates(hashes: DataFrame) -> DataFrame:
    """(a, b, distance): pairs a < b that share a band, once each.

    The pairs themselves are the result, so their number is the caller's: it grows with the square
    of a bucket. ``near_pairs`` and ``candidate_stats`` do not list them.
    """
    k = band_index(hashes)
    a, b = k.alias("a"), k.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.band_value") == F.col("b.band_value")) & (F.col("a.idx") < F.col("b.idx"))
    once = _lowest_common_band(F.col("a.hash"), F.col("b.hash")) == F.col("a.band")
    return a.join(b, same & once).select(F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), hamming(F.col("a.hash"), F.col("b.hash")).alias("distance"))


#: Distinct hashes of a group of bands from which it is split by further bands.
HOT = 500_000


def candidate_stats(hashes: DataFrame) -> DataFrame:
    """(comparisons, naive_comparisons): pairs that share a band, and all pairs.

    The pairs are counted, not listed: by inclusion and exclusion over the sets of bands, from the sizes of the groups
    that agree on a set. A task gets the hashes that agree on one band and counts all sets of which it is the lowest
    (``_shared``), so a hash is sent eight times. A group with more than ``HOT`` hashes counts for its own set only, by
    sums, and its hashes go on as groups of that set and each further band. Copies of a hash are counted by themselves.
    """
    distinct = cut(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")))
    rows = distinct.count()
    counts = [distinct.select(F.expr("coalesce(sum(n * (n - 1) div 2), 0)").alias("pairs"))]
    sets = F.array(*[F.struct(F.lit(signed(255 << BAND_BITS * b)).cast("long").alias("mask"), F.lit(b).alias("top"), F.lit(1).alias("size")) for b in range(BANDS)])
    keyed = distinct.filter("hash IS NOT NULL").select("hash", "n", F.inline(sets))
    while True:
        keyed = keyed.withColumn("key", F.col("hash").bitwiseAND(F.col("mask")))
        if rows <= HOT:
            counts.append(_shared(keyed, BANDS * rows))
            break
        groups = keyed.groupBy("mask", "key", "top", "size").agg(F.sum("n").alias("n"), F.sum(F.expr("n * n")).alias("q"), F.count(F.lit(1)).alias("c"))
        hot = cut(groups.filter(F.col("c") > HOT))
        counts.append(hot.select(F.expr("coalesce(sum(if(size % 2 = 1, 1, -1) * ((n * n - q) div 2)), 0)").alias("pairs")))
        # all groups of a set add up to the distinct hashes, so there are few hot ones
        names = F.broadcast(hot.select("mask", "key"))
        counts.append(_shared(keyed.join(names, ["mask", "key"], "left_anti"), BANDS * rows))
        if hot.isEmpty():
            break
        further = keyed.join(names, ["mask", "key"]).filter(F.col("top") < BANDS - 1)
        further = further.select("hash", "n", "mask", "size", F.explode(F.sequence(F.col("top") + 1, F.lit(BANDS - 1))).alias("top"))
        keyed = cut(further.select("hash", "n", F.expr(f"mask | shiftleft(255L, {BAND_BITS} * top)").alias("mask"), "top", (F.col("size") + 1).alias("size")))
    pairs = reduce(DataFrame.unionByName, counts).agg(F.sum("pairs").cast("long").alias("comparisons"))
    return pairs.crossJoin(hashes.agg(F.expr("count(1) * (count(1) - 1) div 2").alias("naive_comparisons")))


def shared_pairs(h: np.ndarray, n: np.ndarray, key: np.ndarray, top: int, sign: int) -> int:
    """The pairs of different hashes with the same key, with a sign, and those that agree in further bands too, with
    signs in turn. A group of one hash goes into no further band."""
    order = np.argsort(key, kind="stable")
    h, n, key = h[order], n[order], key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    several = (c := np.diff(np.append(starts, len(key)))) > 1
    if not several.any():
        return 0
    total, squares = np.add.reduceat(n, starts)[several], np.add.reduceat(n * n, starts)[several]
    found = sign * int(((total * total - squares) // 2).sum())
    live = np.repeat(several, c)
    h, n, place = h[live], n[live], np.repeat(np.arange(len(total)), c[several])
    for band in range(top + 1, BANDS):
        found += shared_pairs(h, n, place << BAND_BITS | (h >> BAND_BITS * band & 255), band, -sign)
    return found


def _shared(keyed: DataFrame, rows: int) -> DataFrame:
    """(pairs): of each task's groups (mask, key), the signed counts of their sets and of those that extend them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        h, n, mask, top, size = (np.concatenate([b.column(i).to_numpy() for b in held] or [np.zeros(0, np.int64)]) for i in range(5))
        found = 0
        for m in np.unique(mask):
            at = np.flatnonzero(mask == m)
            found += shared_pairs(h[at], n[at], h[at] & m, int(top[at[0]]), 1 if size[at[0]] % 2 else -1)
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["pairs"])

    # tasks of at most about HOT rows, beside what their largest group has
    parts = max(2 * keyed.sparkSession.sparkContext.defaultParallelism, rows // HOT + 1)
    return keyed.repartition(parts, "mask", "key").select("hash", "n", "mask", "top", "size").mapInArrow(run, "pairs long")


#: Most blocks that a key takes.
MOST_FREE = 6


def _blocks(n: int) -> list[int]:
    """The bits of each of n blocks."""
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def free_blocks(rows: int, threshold: int) -> int:
    """How many of t+f blocks a key takes, f: more make longer keys, so smaller buckets, but also more keys.

    The least of the index rows (a shuffled one counts as much as 32 compared pairs) and the pairs of
    buckets that ``rows`` distinct hashes are expected to make. The answer of the join is the same for all.
    """

    def cost(free: int) -> float:
        return comb(threshold + free, free) * rows * (32 + rows / 2 ** (64 * free / (threshold + free) + 1))

    return min(range(2, MOST_FREE + 1), key=cost)


def distinct_hash_pairs(distinct: DataFrame, threshold: int, free: int | None = None) -> DataFrame:
    """(ha, hb, distance): pairs of distinct hashes within the threshold, ha < hb, once each.

    Every ``free`` of t+free blocks form a key; by default as many as suit the number of rows, so
    ``distinct`` should be cut, as it is counted.
    """
    t = clamp_threshold(threshold)
    free = free_blocks(distinct.count(), t) if free is None else free
    blocks = _blocks(t + free)
    sets = []
    for chosen in combinations(range(t + free), free):
        mask = sum(blocks[i] for i in chosen)
        sets.append(F.struct(F.lit(sum(1 << i for i in chosen)).alias("k"), F.lit(signed(mask)).cast("long").alias("mask")))
    index = distinct.select("hash", F.inline(F.array(*sets))).select("hash", "k", F.col("hash").bitwiseAND(F.col("mask")).alias("v"))
    a, b = index.alias("a"), index.alias("b")
    differ = F.col("a.hash").bitwiseXOR(F.col("b.hash"))
    # the first common key of a pair has the lowest of its equal blocks: all others come after the key's last
    equal = reduce(lambda x, y: x.bitwiseOR(y), [F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, F.lit(1 << i)).otherwise(0) for i, m in enumerate(blocks)])
    others = equal.bitwiseXOR(F.col("a.k"))
    first = (others == 0) | (others.bitwiseAND(-others) > F.col("a.k"))
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.hash") < F.col("b.hash"))
    return a.join(b, on & (F.bit_count(differ) <= t) & first).select(F.col("a.hash").alias("ha"), F.col("b.hash").alias("hb"), F.bit_count(differ).alias("distance"))


def near_pairs(hashes: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance) with a < b: every pair of rows within the threshold, copies included."""
    rows = hashed(hashes)
    links = distinct_hash_pairs(cut(rows.select("hash").distinct()), threshold)
    sides = links.join(rows.select(F.col("idx").alias("i"), F.col("hash").alias("ha")), "ha").join(rows.select(F.col("idx").alias("j"), F.col("hash").alias("hb")), "hb")
    across = sides.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")
    x, y = rows.alias("x"), rows.alias("y")
    same = x.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.idx") < F.col("y.idx")))
    return across.unionByName(same.select(F.col("x.idx").alias("a"), F.col("y.idx").alias("b"), F.lit(0).alias("distance")))


def near_groups(hashes: DataFrame, threshold: int) -> DataFrame:
    """(group_id, idx): members of groups of two or more; group_id is the smallest member.

    Links are transitive, so members of a group may be further apart than the threshold.
    """
    rows = hashed(hashes)
    classes = cut(rows.groupBy("hash").agg(F.min("idx").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(distinct_hash_pairs(classes.select("hash"), threshold), "ha", "hb")
    rooted = classes.join(roots, classes["hash"] == roots["node"], "left").select("hash", "least", "n", F.coalesce("component", "hash").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("size")).filter("size >= 2")
    named = rooted.join(groups, "root").select("hash", "group_id")
    return rows.join(named, "hash").select("group_id", "idx")


def group_lists(members: DataFrame) -> DataFrame:
    """(group_id, members): members ascending; order by group_id for the reference order."""
    return members.groupBy("group_id").agg(F.sort_array(F.collect_list("idx")).alias("members"))
