"""Merkle dataset manifest by fractal traversal of aligned blocks.

Every row is a leaf, the digest of its columns. The leaves of a group (a language) stand in the order
of their identifiers, and runs of ``ARITY`` nodes become their digest until one is left, the group's
root; the groups' roots, in the order of the groups, make the root of all in the same way.

Leaves are reduced to thin rows and numbered by ranges, so no group is one task: a third of all rows in a
group are as many blocks as they fill. A block is ``ARITY ** depth`` neighbouring leaves. Its root comes
from a stack of unfinished runs. Block roots are the leaves of the next tree, which is made in the
same way, so their paths to the root, the upper proofs, are found by as many distributed rounds as the
table has powers of a block. A block's leaves then stream behind its upper proof through
a fractal traversal: subtrees of height ``HEIGHT`` are stacked over the present leaf (existing), and those
that the next leaves need are built beside them a step at a time (desired), so of all inner nodes
of a block only two subtrees a level are held. The leaves of one block are held; nothing else.

A proof is a list of levels, from the leaf to the root; each has the digests before and after the node in
its run, joined (hexadecimal digits of fixed length), empty for a run of one. ``folded`` computes a root from
a leaf and a proof in the JVM.

Defined results: a null value is ``-`` in a leaf, so it differs from an empty one; the null group
comes first and null identifiers come first within a group; equal identifiers are ordered by their
leaves, and repeated rows each have their own place and proof; texts are read whole, however long; a
table of one row has its leaf as root and an empty proof; an empty table gives an empty
result. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.operators.ranks import numbered
from nearkin.runtime import cut, small

ARITY, DEPTH, HEIGHT = 8, 4, 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows with their proofs that are given out at a time.
GIVEN = 256
#: Most groups that may be broadcast.
BROADCAST_ROWS = 1_000_000
PROOF = "array<struct<before: string, after: string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """A value as a leaf holds it: its UTF-8 bytes, counted, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _key(group: Column) -> Column:
    """A string in the order of the groups by bytes, the null group first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), group.cast("string")))


class Stack:
    """A root from successive leaves: of each level only the present run is held."""

    def __init__(self) -> None:
        self.levels: list[list[str]] = [[]]
        self.count = 0

    def add(self, node: str) -> None:
        self.count += 1
        level = 0
        self.levels[0].append(node)
        while len(self.levels[level]) == ARITY:
            node = digest(self.levels[level])
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(node)

    def root(self, depth: int) -> str:
        """The node over all leaves so far, ``depth`` levels above them."""
        carried: list[str] = []
        for level in range(depth):
            run = (self.levels[level] if level < len(self.levels) else []) + carried
            carried = [digest(run)] if run else []
        top = self.levels[depth] if depth < len(self.levels) else []
        return (top + carried)[0]


def least_depth(count: int) -> int:
    """Levels until one node is left."""
    depth = 0
    while count > 1:
        count, depth = -(-count // ARITY), depth + 1
    return depth


class Subtree:
    """Nodes of ``height`` levels under one node of a block, level by level from its bottom; built a bottom node at a time."""

    def __init__(self, first: int, count: int, height: int) -> None:
        self.first, self.count, self.height = first, count, height
        self.levels: list[list[str]] = [[] for _ in range(height + 1)]

    def done(self) -> bool:
        return len(self.levels[0]) == self.count

    def add(self, node: str) -> None:
        self.levels[0].append(node)
        last = self.done()
        for level in range(self.height):
            row, made = self.levels[level], len(self.levels[level + 1])
            if len(row) - made * ARITY == ARITY or last and len(row) > made * ARITY:
                self.levels[level + 1].append(digest(row[made * ARITY :]))
            else:
                break


def paths(leaves: list[str], depth: int, height: int = HEIGHT) -> Iterator[list[tuple[str, str]]]:
    """The levels of each leaf's proof within a tree of ``depth`` levels, leaf after leaf.

    The stack has a subtree of at most ``height`` levels for each part of the path. While a leaf's path is
    given out, each desired subtree takes as many steps as it needs to be ready when its turn comes: a
    step of the lowest one reads a leaf, a step of a higher one takes the root of a subtree below it.
    """
    # (levels below it, its levels) from the bottom up
    parts = [(at, min(height, depth - at)) for at in range(0, depth, height)]
    counts = [len(leaves)]
    for _ in range(depth):
        counts.append(-(-counts[-1] // ARITY))

    def fresh(i: int, nth: int) -> Subtree | None:
        at, tall = parts[i]
        wide = ARITY**tall
        return Subtree(nth * wide, min(wide, counts[at] - nth * wide), tall) if nth * wide < counts[at] else None

    def node(at: int, nth: int) -> str:
        """A node ``at`` levels up, from the leaves: it takes the work of a subtree below, and no more memory than a path."""
        if not at:
            return leaves[nth]
        stack = Stack()
        for x in leaves[nth * ARITY**at : (nth + 1) * ARITY**at]:
            stack.add(x)
        return stack.root(at)

    def step(i: int, tree: Subtree) -> None:
        tree.add(node(parts[i][0], tree.first + len(tree.levels[0])))

    existing, desired = [], []
    for i in range(len(parts)):
        tree = fresh(i, 0)
        while not tree.done():
            step(i, tree)
        existing.append(tree)
        desired.append(fresh(i, 1))

    for at in range(len(leaves)):
        for i, (below, tall) in enumerate(parts):
            wide = ARITY ** (below + tall)
            if at and at % wide == 0:
                # the desired one is ready, as it took its steps while the one before was in use
                existing[i], desired[i] = desired[i], fresh(i, at // wide + 1)
            if desired[i] is not None and at % ARITY**below == 0:
                step(i, desired[i]) if not desired[i].done() else None
        path = []
        for i, (below, tall) in enumerate(parts):
            for level in range(tall):
                place = at // ARITY ** (below + level) - existing[i].first // ARITY**level
                run = place - place % ARITY
                row = existing[i].levels[level]
                path.append(("".join(row[run:place]), "".join(row[place + 1 : run + ARITY])))
        yield path


def _rooted(dealt: DataFrame, depth: int) -> DataFrame:
    """(key, block, n, full, least): of each block its leaves, its root ``depth`` levels up and that at the least depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, Stack()

        def out() -> pa.RecordBatch:
            row = [[now[0]], [now[1]], [stack.count], [stack.root(depth)], [stack.root(least_depth(stack.count))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=names)

        names, kinds = ["key", "block", "n", "full", "least"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for key, block, node in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (key, block) != now:
                    if now is not None:
                        yield out()
                    now, stack = (key, block), Stack()
                stack.add(node)
        if now is not None:
            yield out()

    return dealt.select("key", "block", "node").mapInArrow(run, "key string, block long, n long, full string, least string")


def _dealt(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes (key, pos, node, ...), whose places within a key are 0, 1, ..., block by block."""
    return cut(nodes.withColumn("block", F.expr(f"pos div {ARITY**depth}")).repartition("key", "block").sortWithinPartitions("key", "block", "pos"))


def _uppers(dealt: DataFrame, depth: int) -> DataFrame:
    """(key, block, deep, proof, subroot): of each block its proof up to its key's root; a key's only block is not deep."""
    roots = cut(_rooted(dealt, depth))
    several = cut(roots.filter("block > 0").select("key").distinct())
    alone = roots.select("key", "block", F.lit(False).alias("deep"), F.expr(f"cast(array() AS {PROOF})").alias("proof"), F.col("least").alias("subroot"))
    if several.isEmpty():
        return alone
    many = small(several, BROADCAST_ROWS)
    nodes = _dealt(roots.join(many, "key", "left_semi").select("key", F.col("block").alias("pos"), F.col("full").alias("node")), depth)
    above = _traversed(nodes, _uppers(nodes, depth), depth).select("key", F.col("pos").alias("block"), F.lit(True).alias("deep"), "proof", "subroot")
    return above.unionByName(alone.join(many, "key", "left_anti"))


def _traversed(dealt: DataFrame, uppers: DataFrame, depth: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, node, carried columns, proof, subroot): each block streams behind its upper proof through the traversal."""
    none = {"deep": "boolean", "proof": PROOF, "subroot": "string"}
    own = dealt.select("key", "block", "pos", "node", *carry, *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    kinds = dict(dealt.dtypes)
    heads = uppers.select("key", "block", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("node"), *[F.lit(None).cast(kinds[c]).alias(c) for c in carry], *none)
    # by an expression: the planner takes a union's own columns for dealt already and drops the exchange
    stream = own.unionByName(heads).repartition(F.xxhash64("key", "block")).sortWithinPartitions("key", "block", "pos")
    pair = pa.struct([("before", pa.string()), ("after", pa.string())])
    names = ["key", "pos", "node", *carry, "proof", "subroot"]

    def out(key: str, rows: list[list], types: list[pa.DataType], proofs: list[list[tuple[str, str]]], subroot: str) -> pa.RecordBatch:
        flat = [x for p in proofs for x in p]
        levels = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string())], fields=list(pair))
        ends = [0]
        for p in proofs:
            ends.append(ends[-1] + len(p))
        n = len(proofs)
        columns = [pa.array(v, t) for v, t in zip(rows, types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), *columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), levels), pa.array([subroot] * n, pa.string())], names=names)

    def close(key: str, head: dict, rows: list[list], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        above = [(x["before"], x["after"]) for x in head["proof"]]
        held: list[list[tuple[str, str]]] = []
        start, nodes = 0, rows[1]
        for path in paths(nodes, depth if head["deep"] else least_depth(len(nodes))):
            held.append(path + above)
            end = start + len(held)
            if len(held) == GIVEN or end == len(nodes):
                yield out(key, [c[start:end] for c in rows], types, held, head["subroot"])
                start, held = end, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, rows, types = None, None, [], []
        for batch in batches:
            found = [i for i, p in enumerate(batch.column(2).to_pylist()) if p < 0]
            heads = dict(zip(found, batch.take(pa.array(found, pa.int64())).select(list(none)).to_pylist(), strict=True))
            types = [batch.schema.field(c).type for c in ("pos", "node", *carry)]
            values = [batch.column(c).to_pylist() for c in ("pos", "node", *carry)]
            for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if at != now:
                    if now is not None:
                        yield from close(now[0], head, rows, types)
                    now, head, rows = at, heads[i], [[] for _ in values]
                else:
                    for held, v in zip(rows, values, strict=True):
                        held.append(v[i])
        if now is not None:
            yield from close(now[0], head, rows, types)

    carried = "".join(f"{c} {kinds[c]}, " for c in carry)
    return stream.mapInArrow(run, f"key string, pos long, node string, {carried}proof {PROOF}, subroot string")


@dataclass(frozen=True)
class Manifest:
    """rows: (key, pos, node, doc_id, changed, proof, subroot), a row per leaf with its proof up to the
    root of all; subroots: (key, subroot); root: None without leaves. ``key`` names the group."""

    rows: DataFrame
    subroots: DataFrame
    root: str | None


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, node, lambda acc, level: F.sha2(F.concat(level["before"], acc, level["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, joined from the leaf to the root."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), "")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", changed: dict[str, Column] | None = None, depth: int = DEPTH) -> Manifest:
    """The tree of ``docs`` and every leaf's proof, from the leaf to the root of all.

    ``changed`` gives columns by other expressions; the leaves that follow from them are carried along, to be
    held against the proofs.
    """
    changed = changed or {}
    plain = [F.col(f"`{c}`") for c in columns]
    other = [changed.get(c, F.col(f"`{c}`")) for c in columns]
    thin = cut(docs.select(_key(F.col(f"`{group_col}`")).alias("key"), F.col(f"`{id_col}`").alias("doc_id"), leaf(*plain).alias("node"), leaf(*other).alias("changed")))
    order = F.struct("key", F.col("doc_id").isNotNull().alias("known"), "doc_id", "node")
    ranked = cut(numbered(thin.withColumn("_order", order), F.col("_order").asc(), "place").drop("_order"))
    firsts = small(cut(ranked.groupBy("key").agg(F.min("place").alias("first"))), BROADCAST_ROWS)
    dealt = _dealt(ranked.join(firsts, "key").select("key", (F.col("place") - F.col("first")).alias("pos"), "doc_id", "node", "changed"), depth)
    uppers = cut(_uppers(dealt, depth))
    # the groups' roots, in the order of the groups, are the leaves of the last tree
    tops = cut(numbered(uppers.filter("block = 0").select("key", "subroot"), F.col("key").asc(), "pos"))
    nodes = _dealt(tops.select(F.lit("").alias("key"), "pos", F.col("subroot").alias("node")), depth)
    last = cut(_traversed(nodes, _uppers(nodes, depth), depth).select("pos", F.col("proof").alias("last"), F.col("subroot").alias("root")))
    head = last.select("root").first()
    ends = small(cut(tops.join(last, "pos").select("key", "last")), BROADCAST_ROWS)
    whole = uppers.join(ends, "key").select("key", "block", "deep", F.concat("proof", "last").alias("proof"), "subroot")
    return Manifest(_traversed(dealt, whole, depth, ("doc_id", "changed")), tops.select("key", "subroot"), head and head["root"])


def audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document, where the
    capitals of every third text (by the crc32 of the identifier) were lowered after the tree was made."""
    chosen = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 0, F.lit(False))
    text = F.col(f"`{text_col}`")
    made = manifest(docs, changed={text_col: F.when(chosen, F.translate(text, UPPER, UPPER.lower())).otherwise(text)})
    out = made.rows.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(made.root).alias("root"), F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded(F.col("changed"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
