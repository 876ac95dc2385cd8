"""MinHash near-dedup by HyperMinHash sketches.

A document is its set of distinct shingles. Hash functions deal a set into buckets, and the least hash of
a bucket is kept as a register of 16 bits: how many zeros it starts with, and ten bits of what follows. A
sketch has ``BANDS * ROWS`` registers: of large sets 64 buckets each of five functions, of smaller ones fewer
buckets of more functions, so that a bucket of a linked pair is all but never empty (eight shingles a bucket or more).
A set near the end of its size class has a sketch of the next class too, so linked sets share a class.

Every ``ROWS`` registers make a band. Sets that agree in a band are compared by their sketches: agreeing registers
over filled ones, less the collisions expected of compressed registers. Candidates are verified on full sets, so every
link is exact; a linked pair is missed only if all 64 bands differ, (1 - 0.8^5)^64 = 1e-11 at the threshold, or if
its estimate is below ``LEAST`` (less than 1e-9).

Only components are asked for, so no group gives all its pairs. Equal sets are one class first (partial
aggregation). A first round takes eight bands and gives from each bucket a spanning forest of the largest
estimates only; it is verified and joined into components. A second round takes all bands, drops buckets whose sets
are of one component by then, and gives pairs of different components, so nothing is lost. Sets around one text that
are too far from each other would give all their pairs there, only to be refuted: a block with more pairs than half its sets (and
than ``FEW``) is put off. If such blocks have more pairs than there are sets, their pairs are bounded: they share no shingle that only one of these
sets has; of those in up to ``RARE`` sets they share what lists of them share, and of the others at most what either set has. That bound
is exact and small to send. Should there still be more pairs than sets, each component of a block gives its best one first, and these are
verified and joined; then all pairs follow that are still of different components. A bucket of more than ``BLOCK``
sets is never one task: the first round deals it into blocks; in the second, the sets of its commonest component,
which need no comparison with each other, are dealt into blocks, and each meets the other sets block by block.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; a text of fewer words than a shingle is one
shingle; null texts and texts without words have size 0, are linked with nothing and stay; texts are
read whole, however long; repeated rows and equal sets are linked; a document with a null identifier is
linked but lends no component_id (null if a component has no other) and stays only then; an empty table gives an
empty result. Only the identifier and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkin.llm.simhash import shingle_hashes, text_hash
from nearkin.operators.components import connected_components
from nearkin.runtime import cut, shuffles_freed, small

WIDTH = 4
#: Documents are linked from so many hundredths of similarity on.
SIMILARITY = 80
BANDS, ROWS = 64, 5
REGISTERS = BANDS * ROWS
#: Bands of the first round.
FIRST = 8
#: Of each size class: sets from so many shingles on, and the bits that name a bucket.
CLASSES = ((1, 0), (32, 2), (128, 4), (512, 6))
MANTISSA = 10
#: The chance that registers of different least hashes are equal, whatever the size of the sets.
COLLISION = 2.0 ** -(MANTISSA + 2)
#: The least estimate of a pair that is verified, and of one that the first round takes.
LEAST, STRONG = 0.64, 0.8
#: Most sets of a bucket that are compared in one piece.
BLOCK = 512
#: Pairs that a block may always give at once.
FEW = 4
#: Most sets that share a rare shingle; most rare shingles of a set that are listed.
RARE = 64
#: Most rows of blocks put off that may be broadcast.
LATE_ROWS = 100_000
#: Shingles that are counted in one piece, about.
PIECE = 500_000
#: Links whose forest a task makes, about.
LINKS = 10_000
#: Most classes that may be broadcast by name.
BROADCAST_ROWS = 1_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def size_class(n: int) -> int:
    return sum(n >= least for least, _ in CLASSES) - 1


def size_classes(n: int) -> list[int]:
    """The classes that a set of n has sketches of: its own, and that of the largest set it may be linked with."""
    return sorted({size_class(n), size_class(n * 100 // SIMILARITY)})


SEEDS = np.random.default_rng(12).integers(0, 1 << 63, REGISTERS).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def compressed(least: np.ndarray) -> np.ndarray:
    """16-bit registers of least hashes: leading zeros (one more, so that 0 means empty) and the bits after the first one."""
    part, power = np.frexp((least >> np.uint64(11)).astype(np.float64))
    mantissa = np.maximum(0, np.floor((2 * part - 1) * (1 << MANTISSA))).astype(np.uint16)
    return np.where(least == EMPTY, 0, ((54 - power).astype(np.uint16) << MANTISSA) | mantissa).astype(np.uint16)


def sketch(hashes: np.ndarray, kind: int) -> np.ndarray:
    """The registers of a set of shingle hashes in a size class."""
    bits = CLASSES[kind][1]
    functions = REGISTERS >> bits
    least = np.full(REGISTERS, EMPTY)
    # by pieces of a megabyte, which are all the memory that a text takes beside its hashes
    step = max(1, (1 << 17) // functions)
    for i in range(0, len(hashes), step):
        v = _mixed(hashes[None, i : i + step] ^ SEEDS[:functions, None])
        if bits:
            at = (v >> np.uint64(64 - bits)).astype(np.int64) + (np.arange(functions) << bits)[:, None]
            np.minimum.at(least, at.reshape(-1), (v << np.uint64(bits)).reshape(-1))
        else:
            least = np.minimum(least, v.min(axis=1))
    return compressed(least)


def estimates(registers: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The similarity of sketches with one, corrected for collisions of registers."""
    equal, filled = registers == of, None
    if not (registers.all() and of.all()):
        filled = (registers != 0) | (of != 0)
        equal &= registers != 0
    share = equal.sum(1) / (registers.shape[1] if filled is None else np.maximum(1, filled.sum(1)))
    return (share - COLLISION) / (1 - COLLISION)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, same, n, sid, kinds, registers): the size and digest of each document's set, and its sketches by class."""
    head = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(text_col).alias("same"), F.col(f"`{text_col}`").alias("text"))
    kinds = {"n": pa.int64(), "sid": pa.binary(), "kinds": pa.list_(pa.int32()), "registers": pa.list_(pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, width)
                of = size_classes(len(found)) if len(found) else []
                rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), of, [sketch(found, k).tobytes() for k in of]))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "same", *kinds])

    kind = dict(head.dtypes)["doc_id"]
    return head.mapInArrow(run, f"doc_id {kind}, same long, n long, sid binary, kinds array<int>, registers array<binary>")


class Block(NamedTuple):
    """Sets of a bucket that are compared in one piece. ``common`` counts the shingles that other sets may have too; ``rare``
    lists those of them that few have (None: they are not listed)."""

    side: np.ndarray
    cids: np.ndarray
    label: np.ndarray
    n: np.ndarray
    common: np.ndarray
    band: np.ndarray
    rare: np.ndarray
    registers: np.ndarray


#: Ends of pairs.
Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Block]]:
    """The blocks of a stream sorted by (key, block), which are bounded, by these."""
    now, held = None, []
    for batch in batches:
        key, block, *rest = (batch.column(i).to_numpy() for i in range(8))
        rare = np.array([*batch.column(8).to_pylist(), None], object)[:-1]
        registers = np.frombuffer(b"".join(batch.column(9).to_pylist()), "<u2").reshape(-1, REGISTERS)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]) if len(key) else []
        for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
            if (key[s], block[s]) != now:
                if held:
                    yield now, Block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                now, held = (key[s], block[s]), []
            held.append((*(x[s:e] for x in rest), rare[s:e], registers[s:e]))
    if held:
        yield now, Block(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _may(n: np.ndarray, of: int) -> np.ndarray:
    """Whether sizes allow a link at all."""
    return 100 * np.minimum(n, of) >= SIMILARITY * np.maximum(n, of)


def forest(x: Block) -> Pairs:
    """A spanning forest of the largest estimates, of those that are strong: grown from set to set, a row of estimates each."""
    left, best, by, v, tied = np.ones(len(x.cids), bool), np.full(len(x.cids), -1.0), np.zeros(len(x.cids), np.int64), 0, []
    left[0] = False
    while left.any():
        e = np.where(_may(x.n, x.n[v]), estimates(x.registers, x.registers[v]), -1)
        better = left & (e > best)
        best[better], by[better] = e[better], v
        v = int(np.where(left, best, -2).argmax())
        if best[v] >= STRONG:
            tied.append(v)
        left[v] = False
    if tied:
        yield x.cids[by[tied]], x.cids[tied]


def first_band(registers: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The first band in which sketches agree with one (0 if in none)."""
    return (registers == of).reshape(-1, BANDS, ROWS).all(2).argmax(1)


def most_shared(x: Block) -> Callable[[int], np.ndarray]:
    """Of a set, how many shingles each one can share with it at most."""
    listed = np.array([r is not None for r in x.rare], bool)
    hashes = [np.frombuffer(r or b"", np.uint64) for r in x.rare]
    counts = np.array([len(h) for h in hashes], np.int64)
    names, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
    of, ends, often = np.repeat(np.arange(len(x.n)), counts), np.r_[0, np.cumsum(counts)], x.common - counts

    def row(i: int) -> np.ndarray:
        most = np.minimum(x.common, x.common[i])
        if listed[i]:
            mine = np.zeros(len(names), bool)
            mine[place[ends[i] : ends[i + 1]]] = True
            shared = np.bincount(of[mine[place]], minlength=len(x.n))
            most = np.where(listed, np.minimum(most, shared + np.minimum(often, often[i])), most)
        return most

    return row


def _across(x: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each set, those of other labels that it may be linked with by what they can share and by estimates, and these:
    within side 2, and of side 0 with side 1."""
    most = most_shared(x)
    for i in np.flatnonzero(x.side != 1):
        of = ((x.side == 1) if x.side[i] == 0 else np.arange(len(x.side)) > i) & (x.label != x.label[i])
        if of.any():
            shared = most(i)
            at = np.flatnonzero(of & (100 * shared >= SIMILARITY * (x.n + x.n[i] - shared)))
            e = estimates(x.registers[at], x.registers[i])
            yield i, at[e >= LEAST], e[e >= LEAST]


def across(x: Block) -> Pairs:
    """All pairs of different labels that may be linked. A pair is given in the bucket of its first common band only, which holds both."""
    for i, at, _ in _across(x):
        at = at[first_band(x.registers[at], x.registers[i]) == x.band[i]]
        yield np.full(len(at), x.cids[i]), x.cids[at]


def nearest(x: Block) -> Pairs:
    """Of each label, its pair with another one that may be linked and has the largest estimate."""
    names, place = np.unique(x.label, return_inverse=True)
    best, ends = np.full(len(names), -1.0), np.zeros((len(names), 2), np.int64)
    for i, at, e in _across(x):
        # the largest estimate comes last, and stays
        at, e = at[order := np.argsort(e, kind="stable")], e[order]
        for of in (place[at], np.full(len(at), place[i])):
            better = np.flatnonzero(e > best[of])
            best[of[better]] = e[better]
            ends[of[better], 0], ends[of[better], 1] = x.cids[i], x.cids[at[better]]
    ends = ends[best >= 0]
    yield ends[:, 0], ends[:, 1]


def _pairs(rows: DataFrame, give: Callable[[Block], Pairs], put_off: bool = False) -> DataFrame:
    """(a, b, late), a < b, of the blocks of (key, block, side, cid, label, n, common, band, rare, registers). If blocks of many
    pairs are to be put off, such a one gives one row instead: its key, block and number of pairs; ``late`` is 0 for a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, late = [], [], []

        def out() -> pa.RecordBatch:
            x, y = (np.concatenate(v) if v else np.array([], np.int64) for v in (a, b))
            places = np.array(late, np.int64).reshape(-1, 3)
            columns = [np.concatenate([v, places[:, i]]) for i, v in enumerate((np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64)))]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["a", "b", "late"])

        for where, block in _pieces(batches):
            held, found, most = len(a), 0, max(FEW, len(block.cids) // 2)
            for x, y in give(block):
                found += len(x)
                if put_off and found > most:
                    del a[held:], b[held:]
                else:
                    a.append(x)
                    b.append(y)
            if put_off and found > most:
                late.append((*where, found))
            if sum(map(len, a)) > 100_000:
                yield out()
                a, b, late = [], [], []
        yield out()

    dealt = rows.select("key", "block", "side", "cid", "label", "n", "common", "band", "rare", "registers").repartition("key", "block").sortWithinPartitions("key", "block", "cid")
    return dealt.mapInArrow(run, "a long, b long, late long").distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, band, cid, kind, size, label) of buckets with several labels by the blocks in which they are compared: block, side."""
    whole = rows.filter(F.col("size") <= BLOCK).select("key", "band", "cid", "kind", "label", F.lit(0).cast("long").alias("block"), F.lit(2).alias("side"))
    large = cut(rows.filter(F.col("size") > BLOCK))
    if large.isEmpty():
        return whole
    counts = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    tops = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("majors"), F.sum("c").alias("all"))
    known = large.join(tops, "key").withColumns({
        "xs": F.ceil(F.col("majors") / BLOCK).cast("int"), "ys": F.ceil((F.col("all") - F.col("majors")) / BLOCK).cast("int"), "major": F.col("label") == F.col("top")})
    at = F.pmod(F.xxhash64("key", "cid"), F.when(F.col("major"), F.col("xs")).otherwise(F.col("ys"))).cast("int")
    # (x, y): commonest label against others; (-1 - y, z): others with others, y <= z
    places = F.expr("""CASE WHEN major THEN transform(sequence(0, ys - 1), y -> struct(at AS x, y AS y, 0 AS side))
      ELSE concat(transform(sequence(0, xs - 1), x -> struct(x AS x, at AS y, 1 AS side)),
                  transform(sequence(0, ys - 1), z -> struct(-1 - least(at, z) AS x, greatest(at, z) AS y, CASE WHEN z = at THEN 2 WHEN at < z THEN 0 ELSE 1 END AS side))) END""")
    dealt = known.withColumn("at", at).select("key", "band", "cid", "kind", "label", F.inline(places))
    return whole.unionByName(dealt.select("key", "band", "cid", "kind", "label", F.expr("x * 4294967296 + y").alias("block"), "side"))


def _sets(cids: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(cid, hashes): the full sets of classes. Only texts that stand for one of them are read again."""
    named = cut(cids.join(classes.select("cid", "best"), "cid").select("cid", "best.doc_id", "best.same"))
    plain = docs.select(F.col(f"`{id_col}`").alias("_id"), text_hash(text_col).alias("_same"), F.col(f"`{text_col}`").alias("text"))
    texts = plain.join(small(named, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_same") == F.col("same"))).select("cid", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["cid", "hashes"])

    # repeated rows of one text give one set
    return cut(texts.mapInArrow(hashed, "cid long, hashes binary").groupBy("cid").agg(F.first("hashes").alias("hashes")))


def _runs(hashes: np.ndarray, cids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (hash, cid) by hash, and how many its hash has; cid -1 counts as more than ``RARE``."""
    order = np.argsort(hashes, kind="stable")
    hashes, cids = hashes[order], cids[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    c = np.diff(np.r_[starts, len(hashes)])
    return hashes, cids, np.repeat(np.where(np.add.reduceat(cids < 0, starts) > 0, RARE + 1, c) if len(c) else c, c)


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(cid, own, rare): of each set of (cid, hashes) how many shingles no other one has, and those that 2 to ``RARE`` have.
    Sets that have neither are left out."""
    least = 2 * sets.sparkSession.sparkContext.defaultParallelism
    parts = max(least, (sets.agg(F.sum(F.length("hashes"))).first()[0] or 0) // (8 * PIECE))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            hashes, cids, c = _runs(np.concatenate([np.zeros(0, np.uint64), *found]), np.repeat(batch.column(0).to_numpy(), [len(x) for x in found]))
            # a hash that many have is sent once a batch
            cids = np.where(c > RARE, -1, cids)
            once = (c <= RARE) | np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
            hashes, cids = hashes[once], cids[once]
            part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            cells = [(k, hashes[at].tobytes(), cids[at].tobytes()) for k in range(parts) if len(at := order[ends[k] : ends[k + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["part", "hashes", "cids"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        hashes, cids, c = _runs(*(np.frombuffer(b"".join(x for b in held for x in b.column(i).to_pylist()), t) for i, t in ((1, np.uint64), (2, np.int64))))
        order = np.flatnonzero(c <= RARE)
        order = order[np.argsort(cids[order], kind="stable")]
        hashes, cids, several = hashes[order], cids[order], c[order] > 1
        names, starts = np.unique(cids, return_index=True)
        pieces = [slice(s, e) for s, e in zip(starts, np.r_[starts[1:], len(cids)][: len(starts)], strict=True)]
        rows = [(int((~several[at]).sum()), hashes[at][several[at]].tobytes()) for at in pieces]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cid", "own", "rare"])

    cells = sets.select("cid", "hashes").mapInArrow(dealt, "part long, hashes binary, cids binary").repartition(parts, "part")
    joined = F.expr("aggregate(collect_list(rare), CAST('' AS BINARY), (x, y) -> concat(x, y))")
    return cells.mapInArrow(counted, "cid long, own long, rare binary").groupBy("cid").agg(F.sum("own").alias("own"), joined.alias("rare"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), classes, docs, id_col, text_col, width)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = (len(x) + len(y)) // 8
                both = np.sort(np.frombuffer(x + y, np.uint64), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= SIMILARITY * (n - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), "a")
    return cut(sides.select("a", "b", "x", "y").mapInArrow(linked, "a long, b long"))


def _put_off(blocks: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the blocks that were put off, and how many pairs these have."""
    places = found.filter("late > 0").select(F.col("a").alias("key"), F.col("b").alias("block"), "late")
    many = places.agg(F.sum("late")).first()[0] or 0
    return cut(blocks.join(places.drop("late"), ["key", "block"])) if many else blocks, many


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of links that are cut: by as few tasks as they need, since each makes a forest of its own links first."""
    return connected_components(links.coalesce(max(1, links.count() // LINKS)))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component of their class as label."""
    roots = _components(links).withColumnsRenamed({"node": "cid", "component": "root"})
    return rows.drop("label").join(roots, "cid", "left").withColumn("label", F.coalesce("root", "cid")).drop("root")


def near_links(classes: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Links (a, b) whose components are those of all similar sets. ``classes``: (cid, best, n, kinds, registers)."""
    each = classes.select("cid", "n", F.inline(F.arrays_zip(F.col("kinds").alias("kind"), F.col("registers").alias("registers"))))
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> struct(i AS band, xxhash64(kind, i, substring(registers, {2 * ROWS} * i + 1, {2 * ROWS})) AS key))")
    keyed = each.select("cid", "kind", F.inline(bands))
    shared = cut(keyed.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("size > 1"))

    salt = F.pmod(F.xxhash64("key", "cid"), F.ceil(F.col("size") / BLOCK))
    start = shared.filter(F.col("band") < FIRST).select("key", "band", "cid", "kind", salt.cast("long").alias("block"), F.lit(2).alias("side"), F.lit(0).cast("long").alias("label"))
    whole = each.withColumns({"common": F.col("n"), "rare": F.lit(None).cast("binary")})
    strong = cut(_pairs(start.join(whole, ["cid", "kind"]), forest).select("a", "b"))
    links = _verified(strong, classes, docs, id_col, text_col, width)

    labelled = _labelled(shared, links)
    same = Window.partitionBy("key")
    mixed = labelled.withColumns({"lo": F.min("label").over(same), "hi": F.max("label").over(same)}).filter("lo <> hi").drop("lo", "hi")
    blocks = _blocks(cut(mixed))
    found = cut(_pairs(blocks.join(whole, ["cid", "kind"]), across, True))
    rest, sets = found.filter("late = 0"), classes.count()
    late, many = _put_off(blocks, found)
    if many > sets:
        rare = rare_shingles(_sets(late.select("cid").distinct(), classes, docs, id_col, text_col, width))
        bounded = each.join(rare, "cid", "left").select(
            "cid", "kind", "n", "registers", F.expr("n - coalesce(own, 0)").alias("common"), F.expr(f"CASE WHEN length(rare) <= {8 * RARE} THEN rare WHEN rare IS NULL THEN X'' END").alias("rare"))
        late = cut(late.join(bounded, ["cid", "kind"]))
        found = cut(_pairs(late, across, True))
        rest = rest.unionByName(found.filter("late = 0"))
        late, many = _put_off(late, found)
        if many > sets:
            links = links.unionByName(_verified(cut(_pairs(late, nearest)), classes, docs, id_col, text_col, width))
            late = _labelled(late, links)
    elif many:
        late = each.join(small(late, LATE_ROWS), ["cid", "kind"]).withColumns({"common": F.col("n"), "rare": F.lit(None).cast("binary")})
    if many:
        rest = cut(rest.unionByName(_pairs(late, across)).select("a", "b").distinct())
    return links.unionByName(_verified(rest.select("a", "b"), classes, docs, id_col, text_col, width))


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept."""
    with shuffles_freed(docs.sparkSession):
        prints = cut(sketches(docs, id_col, text_col, width))
        # null identifiers come last
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same"))
        grouped = prints.filter("n > 0").groupBy("sid").agg(best.alias("best"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first(F.struct("kinds", "registers")).alias("s"))
        classes = cut(grouped.select(F.monotonically_increasing_id().alias("cid"), "sid", "best", "least", "n", "s.kinds", "s.registers"))
        roots = _components(near_links(classes, docs, id_col, text_col, width))
    rooted = classes.select("cid", "sid", "least").join(roots, F.col("cid") == F.col("node"), "left").select("sid", "least", F.coalesce("component", "cid").alias("root"))
    ids = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "component_id")
    thin = prints.select("doc_id", F.col("n").alias("n_shingles"), "sid")
    linked = thin.filter("n_shingles > 0").join(ids, "sid").select("doc_id", "n_shingles", "component_id")
    every = linked.unionByName(thin.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
