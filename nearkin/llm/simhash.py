"""SimHash near-dedup by covering locality-sensitive hashing.

For a radius r every bit position gets a random vector of r+1 bits (not all zero); table v, for
each of the 2^(r+1)-1 non-zero vectors v, keeps the positions whose vector has an odd product with
v. Any r positions leave some v orthogonal to all of them, so two fingerprints that differ in r
positions or fewer agree in all that table v keeps: every pair within the radius collides in some
table. All collisions are verified, so links are exact.

Scale: documents are reduced to distinct fingerprints first (partial aggregation, however many
share one). Buckets are runs of a sorted partition, read as a stream. A bucket of up to ``dense``
fingerprints is compared as a matrix and gives a spanning forest, never its pairs. A larger one is
not held at all: its fingerprints go to a next round of tables with other masks, within the
bucket, which again cover every pair; the positions left free about halve each round, so rounds
end with small buckets. Components come from ``connected_components``.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked
like any other; texts are read whole, however long; documents with a null identifier are linked but
lend no component_id (null if a component has no other); ties go to the smallest identifier; repeated
rows keep their own row; an empty table gives an empty result. Only the identifier and text columns
are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.operators.components import connected_components
from nearkin.runtime import cut, small

BITS = 64
LANES = np.uint64(0x0001000100010001)
PIECE = 50_000
BATCH = 200_000
MAX_ROUNDS = 8
#: Most identifiers that may be broadcast.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of each shingle; words are [^\\x20\\x09-\\x0D]+ with A-Z lowered."""
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    h, join = xxhash.xxh64_intdigest, b" ".join
    return [h(join(s), 42) for s in zip(*(words[i:] for i in range(width)), strict=False)]


def _lane_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set in each piece; a piece has at most ``PIECE`` hashes, so 16-bit lanes hold it."""
    out = np.empty((len(starts), BITS), np.int64)
    for k in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts)
        for lane in range(4):
            out[:, k + 16 * lane] = (sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
    return out


def fingerprints(texts: list[str | None], width: int = 3) -> np.ndarray:
    """The 64-bit fingerprints: a bit is set if more than half of the hashes have it."""
    counts, sizes = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held, owners, starts, n = [], [], [], 0

    def flush() -> None:
        nonlocal held, owners, starts, n
        if n:
            found = _lane_counts(np.concatenate(held), np.array(starts))
            np.add.at(counts, np.array(owners), found)
        held, owners, starts, n = [], [], [], 0

    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, width), np.uint64)
        sizes[i] = len(hashes)
        for at in range(0, len(hashes), PIECE):
            part = hashes[at : at + PIECE]
            held.append(part)
            owners.append(i)
            starts.append(n)
            n += len(part)
            if n >= BATCH:
                flush()
    flush()
    bits = counts * 2 > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, same, fp): the fingerprint as a signed 64-bit number; ``same`` is a hash of the text, so
    that rows of one identifier with different texts can be told apart."""
    schema = docs.select(F.col(f"`{id_col}`").alias("doc_id")).withColumns({"same": F.lit(0).cast("long"), "fp": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints(batch.column(2).to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "same", "fp"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(text_col).alias("same"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def covering_masks(radius: int, seed: int) -> list[int]:
    """The kept positions of each table, as signed 64-bit masks."""
    dims = radius + 1
    vectors = np.random.default_rng([seed, radius]).integers(1, 1 << dims, BITS)
    masks = []
    for v in range(1, 1 << dims):
        kept = sum(1 << i for i in range(BITS) if int(vectors[i] & v).bit_count() & 1)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def _keyed(rows: DataFrame, radius: int, seed: int) -> DataFrame:
    """(key, fp) for each table; the key also holds the bucket that the row comes from."""

    def keys(*parent: Column) -> Column:
        return F.array(*[F.xxhash64(*parent, F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius, seed))])

    return rows.select("fp", F.explode(keys(F.col("key"))).alias("key"))


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that is linked within a bucket, and the first one of its component."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[moved]], fps[moved]


def _buckets(batches: Iterator[pa.RecordBatch], radius: int, dense: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b) of a sorted stream of (key, fp): links have a null key; rows of large buckets come back with b null."""
    key, held, large = None, [], False

    def out(keys: list, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        ends = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a.view(np.int64)), ends], names=["key", "a", "b"])

    def close() -> Iterator[pa.RecordBatch]:
        fps = np.unique(np.concatenate(held)) if held else np.array([], np.uint64)
        if not large and len(fps) > 1:
            a, b = _forest(fps, radius)
            if len(a):
                yield out([None] * len(a), a, b)

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(starts, ends, strict=True):
            last = e == len(keys)
            if keys[s] != key:
                yield from close()
                if not last and e - s == 1:
                    key, held, large = keys[s], [], False
                    continue
                key, held, large = keys[s], [], False
            part = fps[s:e]
            if not large and dense is not None and sum(map(len, held)) + len(part) > dense:
                for x in held:
                    yield out([int(key)] * len(x), x, None)
                held, large = [], True
            if large:
                yield out([int(key)] * len(part), part, None)
            else:
                held.append(part)
            if not last:
                if not large and sum(map(len, held)) > 1:
                    links.append(_forest(np.unique(np.concatenate(held)), radius))
                held = []
        if links and sum(len(a) for a, _ in links):
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            yield out([None] * len(a), a, b)
    yield from close()


def near_links(distinct: DataFrame, radius: int = 3, dense: int = 1024, seed: int = 5) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct.fp`` within the radius."""
    rows, found, round_ = distinct.select("fp", F.lit(0).cast("long").alias("key")), None, 0
    while True:
        limit = dense if round_ < MAX_ROUNDS else None
        dealt = _keyed(rows, radius, seed + round_).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        out = cut(dealt.mapInArrow(lambda it, limit=limit: _buckets(it, radius, limit), "key long, a long, b long"))
        links = out.filter("key IS NULL").select("a", "b").distinct()
        found = links if found is None else found.union(links)
        rows = out.filter("key IS NOT NULL").select(F.col("a").alias("fp"), "key")
        if rows.isEmpty():
            return found
        round_ += 1


def _rooted(prints: DataFrame, radius: int, dense: int) -> DataFrame:
    """(fp, best, root): each distinct fingerprint with its first document, and that of its component."""
    # null identifiers come last
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")
    classes = prints.groupBy("fp").agg(F.min(first).alias("best"), F.min("doc_id").alias("least"))
    comps = connected_components(near_links(classes.select("fp"), radius, dense))
    return classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "best", "least", F.coalesce("component", "fp").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, dense: int = 1024) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = cut(fingerprint_table(docs, id_col, text_col, width))
    rooted = _rooted(prints, radius, dense)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, dense: int = 1024) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest identifier (null
    identifiers last), and of repeated rows any one.

    Rows are named by identifier and text together, so an identifier that stands for several texts
    loses only those that it should. Only these names of dropped documents meet the texts again: by
    broadcast if they are few. Columns may have any name.
    """
    prints = cut(fingerprint_table(docs, id_col, text_col, width))
    rooted = _rooted(prints, radius, dense)
    best = rooted.groupBy("root").agg(F.min("best").alias("keep"))
    keeps = rooted.select("fp", "root").join(best, "root").select("fp", F.col("keep.doc_id").alias("keep_id"), F.col("keep.same").alias("keep_same"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("same") == F.col("keep_same"))
    decided = prints.join(keeps, "fp").select("doc_id", "same", stays.alias("stays"))
    named = cut(decided.groupBy("doc_id", "same", "stays").agg(F.count(F.lit(1)).alias("n")).filter("NOT stays OR n > 1"))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col(f"`{id_col}`").alias("_id"), text_hash(text_col).alias("_same"))

    def of(names: DataFrame, how: str) -> DataFrame:
        on = plain["_id"].eqNullSafe(names["doc_id"]) & (plain["_same"] == names["same"])
        return plain.join(small(names, BROADCAST_ROWS), on, how)

    out = of(named.select("doc_id", "same"), "left_anti")
    again = named.filter("stays").select("doc_id", "same")
    if not again.isEmpty():
        out = out.unionByName(of(again, "left_semi").dropDuplicates(["_id", "_same"]))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
