"""Mixing sources to target weights.

The words of each source, its documents one after another in a fixed order, are packed into
blocks of ``block`` words. A source's target says how many slots it fills: whole passes over its
blocks, then part of one more pass, whose last slot is cut so that the source's words come to the
target rounded down. A source's slots are dealt to the output shards by a multinomial draw with
equal chances, which is the law of multinomial source counts per shard given that every source
meets its target; so shards have about, not exactly, equally many slots. Slot ``j`` of a source is
block ``permutation(j mod blocks)``, a keyed Feistel permutation of that pass, and slots and blocks
meet in a join on (source, block).

Nothing of a size that grows with the data reaches the driver: targets come from sums over the table of
sources (a few rounds, as capped sources leave their excess to the rest), draws are made by source
on the executors, in two levels (groups of shards, then shards). Positions within a source come
from two levels of prefix sums (4,096 hash buckets, then rows within a bucket), so no task holds a
whole source.

Defined results: a null text has size 0, a null source is a source of its own and the last one,
documents of size 0 take nothing, texts are counted whole, however long, repeated rows and null identifiers are
separate documents (of rows that are equal in identifier and text any one may take the words), an empty
table gives an empty result. Only the three named columns are read, so others may have any name.
Reruns agree: draws and permutations depend on ``seed`` alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearkin.operators.ranks import numbered
from nearkin.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 4
BUCKETS = 4096
#: Shards that are drawn together.
GROUP = 4096
#: Most sources that may be broadcast; beyond it their table is joined in SALTS copies.
BROADCAST_ROWS, SALTS = 500_000, 64
SOURCE = "s long, source string, source_size long, target double"
PLANNED = f"{SOURCE}, blocks long, quota long, last long, key long"


@dataclass
class Mixture:
    """documents: the contract's row per document; slots: what each output slot holds (shard, slot,
    s (the source's number), block, limit in words); pieces: words ``lo`` to ``hi`` of a block are those of a
    document from its word ``at`` on; places: where the words of each document lie in its source."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame
    places: DataFrame

    def spans(self) -> DataFrame:
        """The mix itself: (shard, slot, s, lo, doc_id, same, at, words), which words of which document
        stand where; ``lo`` orders the documents of a slot."""
        taken = F.least("hi", "limit") - F.col("lo")
        both = self.slots.hint("merge").join(self.pieces, ["s", "block"])
        return both.filter(taken > 0).select("shard", "slot", "s", "lo", "doc_id", "same", "at", taken.alias("words"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` (s, source_size, ...) with the words to take from each source: ``share`` of all words by
    weight, each at most ``cap`` times its size."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    most = F.col("source_size") * float(cap)
    rows = sizes.filter("source_size > 0")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    unit, full = 0.0, -1
    while True:
        # a source that is full stays so, as what a unit of weight gets never falls
        free = weight * unit < most if full >= 0 else F.lit(True)
        of = rows.agg(F.sum(F.when(free, weight)), F.sum(F.when(~free, most)), F.count_if(~free)).first()
        if of[2] == full or not of[0]:
            break
        full = of[2]
        unit = (share * total - (of[1] or 0.0)) / of[0]
    return sizes.withColumn("target", F.when(F.col("source_size") > 0, F.least(weight * unit, most)).otherwise(0.0))


def _key(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little") >> 1


def _half_bits(n: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n)) / 2))


def _mixed(x: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    z = (x + key + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, backwards: bool = False) -> np.ndarray:
    """A keyed permutation of 0 .. n-1 (Feistel rounds, walked until the value is below n), or its inverse."""
    x, n, key = x.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    sizes, which = np.unique(n, return_inverse=True)
    bits = np.array([_half_bits(int(v)) for v in sizes], np.uint64)[which]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        v, b, m, k = out[todo], bits[todo], mask[todo], key[todo]
        left, right = v >> b, v & m
        for r in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
            if backwards:
                left, right = right ^ (_mixed(left, k, r) & m), left
            else:
                left, right = right, left ^ (_mixed(right, k, r) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _plan(size: int, target: float, block: int, key: int) -> tuple[int, int, int]:
    """(blocks, slots, words that the last slot may take) of one source."""
    if not size:
        return 0, 0, block
    blocks = -(-size // block)
    passes, rest = divmod(min(int(target + 1e-6), 2 * size) if target else 0, size)
    if not rest:
        return blocks, passes * blocks, block
    short = size - (blocks - 1) * block
    at = int(permuted(np.array([blocks - 1]), np.array([blocks]), np.array([key + passes]), backwards=True)[0])
    more = -(-rest // block)
    if more > at:
        more = -(-(rest + block - short) // block)
    before = (more - 1) * block - (block - short if more - 1 > at else 0)
    return blocks, passes * blocks + more, rest - before


def _sources(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float, block: int, seed: int) -> DataFrame:
    """A row per source: its number in code point order (null last), size, target, slots and key."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(cut(numbered(sums, F.col("source").asc_nulls_last(), "s")), weights, share, cap)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, aims = (batch.column(i).to_pylist() for i in (1, 2, 3))
            keys = [_key(seed, "source", name) & ~7 for name in names]
            plans = [_plan(n, t, block, k) for n, t, k in zip(sizes, aims, keys, strict=True)]
            more = [pa.array([p[i] for p in plans], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(keys, pa.int64())], names=[x.split()[0] for x in PLANNED.split(", ")])

    return cut(wanted.select("s", "source", "source_size", "target").mapInArrow(plan, PLANNED))


def _with_source(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with its source's row; a source that very many documents share is not one task."""
    own = sources.select(F.col("source").alias("of"), "s", "source_size", "target")
    few = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        return sized.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    salt = F.pmod(F.xxhash64("doc_id", "same"), F.lit(SALTS)).cast("int")
    copies = own.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of"))
    return sized.withColumn("salt", salt).join(copies, on).drop("of", "salt", "salt_of")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 1024, shard_slots: int = 1024, seed: int = 11) -> Mixture:
    """Mix the documents of all sources; ``weights`` repeat over the sources in code point order, null last.

    ``cap`` is at most 2. ``shard_slots``: slots of an output shard, on average at least.
    """
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), _same(text).alias("same")))
    sources = _sources(sized, weights, share, cap, block, seed)
    hashed = _with_source(sized, sources).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(BUCKETS)).cast("int"))
    sums = hashed.groupBy("s", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("s", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    above = Window.partitionBy("s", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "same").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("within", F.coalesce(F.sum("size").over(above), F.lit(0))).join(bases, ["s", "bucket"])
    placed = placed.select("doc_id", "same", "size", "s", "source_size", "target", (F.col("base") + F.col("within")).alias("start"))

    pieces = placed.filter("size > 0").select("doc_id", "same", "s", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    first = F.col("block") * block
    lo, hi = F.greatest(F.col("start") - first, F.lit(0)), F.least(F.col("start") + F.col("size") - first, F.lit(block))
    pieces = pieces.select("doc_id", "same", "s", "start", "block", lo.alias("lo"), hi.alias("hi"), (first + lo - F.col("start")).alias("at"))

    slots = _slots(sources, block, shard_slots, seed)
    # the planner takes exploded slots for a small table; both sides grow with the words
    taken = slots.hint("merge").join(pieces.select("s", "start", "block", "lo", "hi"), ["s", "block"]).groupBy("s", "start").agg(F.sum(F.greatest(F.least("hi", "limit") - F.col("lo"), F.lit(0))).alias("taken"))
    out = placed.alias("p").join(taken.alias("t"), (F.col("p.s") == F.col("t.s")) & (F.col("p.start") == F.col("t.start")) & (F.col("p.size") > 0), "left")
    documents = out.select("p.doc_id", "p.size", "p.source_size", "p.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))
    return Mixture(documents, slots, pieces, placed.select("doc_id", "same", "size", "s", "start"))


def _same(text: Column) -> Column:
    """A hash of the text, which tells rows of one identifier apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mixed_texts(docs: DataFrame, mixture: Mixture, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, slot, text): the words of each output slot, a blank between them. ``block`` as for the mixture.

    Each text is cut into its blocks once; its pieces then meet the slots that hold them.
    """
    text = F.col(f"`{text_col}`")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), _same(text).alias("hash"), text.alias("text")).dropDuplicates(["id", "hash"])
    rows = mixture.places.filter("size > 0").join(own, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("hash")))
    part = f"struct(b AS block, greatest(start - b * {block}, 0L) AS lo, slice(w, CAST(greatest(b * {block} - start, 0L) AS INT) + 1, CAST(least(start + size, (b + 1) * {block}) - greatest(start, b * {block}) AS INT)) AS words)"
    blocks = f"transform(sequence(start div {block}, (start + size - 1) div {block}), b -> {part})"
    parts = rows.select("s", F.expr(rf"inline(flatten(transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w -> {blocks})))"))
    both = mixture.slots.hint("merge").join(parts, ["s", "block"]).filter(F.col("limit") > F.col("lo"))
    cut_words = F.slice("words", F.lit(1), F.least(F.size("words"), F.col("limit") - F.col("lo")).cast("int"))
    # a slot has at most ``block`` words
    held = both.groupBy("shard", "s", "slot").agg(F.sort_array(F.collect_list(F.struct("lo", cut_words.alias("words")))).alias("parts"))
    return held.select("shard", "s", "slot", F.array_join(F.flatten("parts.words"), " ").alias("text"))


def write_shards(docs: DataFrame, mixture: Mixture, folder: str, block: int = 1024, **columns: str) -> DataFrame:
    """Write the text of every slot below ``folder``, a shard's slots together and in order; gives what was written."""
    texts = mixed_texts(docs, mixture, block, **columns)
    texts.repartition("shard").sortWithinPartitions("shard", "s", "slot").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _dealt(n: int, first: int, sizes: list[int], *key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n`` slots from ``first`` on, dealt by a multinomial draw with chances in proportion to ``sizes``:
    the places that get any, how many, and the first slot of each."""
    weights = np.array(sizes, float)
    drawn = np.random.default_rng(list(key)).multinomial(n, weights / weights.sum())
    to = np.flatnonzero(drawn)
    return to, drawn[to], first + (np.cumsum(drawn) - drawn)[to]


def _slots(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, s, block, limit): one row for each output slot."""
    total = sources.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, total // shard_slots)
    groups = -(-shards // GROUP)
    of = "s long, blocks long, quota long, last long, key long"
    names = ["place", "n", "first", *(x.split()[0] for x in of.split(", "))]

    def out(rows: list[tuple], batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        found = [np.concatenate([r[k] for r in rows]) if rows else np.array([], np.int64) for k in range(3)]
        return pa.RecordBatch.from_arrays([*(pa.array(f.astype(np.int64)) for f in found), *(batch.column(i).take(pa.array(owner)) for i in range(at, at + 5))], names=names)

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [min(GROUP, shards - g * GROUP) for g in range(groups)]
        for batch in batches:
            quotas, keys = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            yield out([_dealt(q, 0, sizes, seed, k) for q, k in zip(quotas, keys, strict=True)], batch, 0)

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, n, first, key in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 7)), strict=True):
                to, some, firsts = _dealt(n, first, [1] * min(GROUP, shards - g * GROUP), seed, key, g + 1)
                rows.append((to + g * GROUP, some, firsts))
            yield out(rows, batch, 3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot, s, blocks, quota, last, key = (c.to_numpy() for c in batch.columns)
            limit = np.where(slot == quota - 1, last, block)
            columns = [shard, slot, s, permuted(slot % blocks, blocks, key + slot // blocks), limit]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "slot", "s", "block", "limit"])

    dealt = sources.filter("quota > 0").select("s", "blocks", "quota", "last", "key").mapInArrow(to_groups, f"place long, n long, first long, {of}")
    drawn = dealt.repartition("s", "place").mapInArrow(to_shards, f"place long, n long, first long, {of}").repartition("place", "s")
    each = drawn.select(F.col("place").alias("shard"), F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"), "s", "blocks", "quota", "last", "key")
    return each.mapInArrow(place, "shard long, slot long, s long, block long, limit long")
