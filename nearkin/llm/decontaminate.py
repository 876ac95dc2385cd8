"""Benchmark decontamination (DataFrame and SQL functions only).

Windows as long as a benchmark item slide over each document. Windows that share enough five-word
shingles with the item, by their hashes, are candidates. They are verified by weighted shingle
similarity: shingles count as often as they occur, and the similarity is the sum of the smaller
counts over the sum of the larger ones. A document is contaminated by an item if some window
reaches ``similarity``.

Candidates come from an exact count, not from SimHash fingerprints and Hamming blocks, as these cannot
give all pairs of similarity 0.8: simulated, pairs of 55 shingles lie 9.4 of 64 bits apart on average,
so that a radius of 7, whose 8-bit blocks still select, finds 26% of them; a radius of 24, which
finds them, has blocks of two or three bits, of which 99% of unrelated pairs share one; and as a
shingle that repeats weighs as often in a fingerprint, 39% of pairs with 80 shared shingles and
one more that stands ten times lie beyond even that.

First, documents that can reach it: as the sums must agree in at least ``similarity`` times the item's
shingles, one of any set of its shingles that makes up more than the rest must be there. That set is of
its rarest ones among all items. Then, windows that can reach it: a shared shingle counts in the windows that
hold it, unless they hold it as often as the item already, so sums over the ends of these ranges of
starts give what each window shares with the item, in any order. Of each document and item the best
start is built, and its words decide; should they disagree with the hashes, every start of that pair that shares
enough is built.

Defined results: null texts have no words; texts are read whole, however long; a document with fewer
words than an item is one window; items of fewer than five words are one shingle; items without a
word match nothing; of windows that tie the first counts; of repeated rows of a doc_id and of an item_id
the best match counts; null identifiers are identifiers like any other; empty tables give an empty
result. Only the identifier and text columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.runtime import cut, small

WIDTH = 5
SIMILARITY = 0.8
#: Most shingle hashes of items that go into a plan as constants; beyond it the same documents come from a join.
INLINE = 20_000
#: Most rows of a table that may be broadcast.
BROADCAST_ROWS = 500_000

WORDS = r"array_remove(split(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), '')"


def _hash_at(width: int) -> str:
    """The hash of the shingle at place i (from 0) of the words w."""
    return f"xxhash64({', '.join(f'get(w, i + {j})' for j in range(width))})"


def _hashes(words: str, width: int) -> str:
    """All shingle hashes of an array of words, which is bound once."""
    return f"flatten(transform(array({words}), w -> if(size(w) < {width}, array(), transform(sequence(0, size(w) - {width}), i -> {_hash_at(width)}))))"


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, w, length, width): items with a word, numbered."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    words = rows.select("item_id", F.expr(WORDS).alias("w")).filter("size(w) > 0")
    out = words.withColumns({"item": F.monotonically_increasing_id(), "length": F.size("w")})
    return cut(out.withColumn("width", F.least("length", F.lit(WIDTH))))


def _rarest(shingles: DataFrame, similarity: float) -> DataFrame:
    """(hash, width) of each item's rarest shingles that together are more than a match can lack."""
    seen = shingles.withColumn("seen", F.count(F.lit(1)).over(Window.partitionBy("hash", "width")))
    order = Window.partitionBy("item").orderBy("seen", "hash", "at")
    placed = seen.withColumns({"nth": F.row_number().over(order), "m": F.count(F.lit(1)).over(Window.partitionBy("item"))})
    return placed.filter(F.col("nth") <= F.floor((1 - similarity) * F.col("m") + 1e-9) + 1).select("hash", "width").distinct()


def _with_shingle(docs: DataFrame, shingles: DataFrame, widths: list[int]) -> DataFrame:
    """(row, doc_id, text) of the documents that have one of the shingles."""
    shingles = cut(shingles)
    if shingles.count() <= INLINE:
        found = "false"
        for k in widths:
            hashes = ", ".join(f"{r[0]}L" if r[0] > -(1 << 63) else "-9223372036854775807L - 1L" for r in shingles.filter(F.col("width") == k).select("hash").collect())
            found += f" OR exists(array({WORDS}), w -> size(w) >= {k} AND exists(sequence(0, greatest(size(w) - {k}, 0)), i -> {_hash_at(k)} IN ({hashes})))"
        some = docs.filter(F.expr(found))
    else:
        every = F.explode(F.array_distinct(F.expr(f"concat({', '.join(_hashes(WORDS, k) for k in widths)})")))
        wanted = small(cut(shingles.select("hash").distinct()), BROADCAST_ROWS)
        shared = docs.select("doc_id", every.alias("hash")).join(wanted, "hash", "left_semi").select(F.col("doc_id").alias("hit")).distinct()
        some = docs.join(shared, F.col("doc_id").eqNullSafe(F.col("hit")), "left_semi")
    return cut(some.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document and item whose similarity is reached: doc_id, item_id, similarity (the
    best), start (the window's first word, from 0; the first of equals) and n_words of the window."""
    items = _items(benchmark, item_col, item_text)
    shingles = cut(items.select("item", "length", "width", F.expr(f"posexplode(CASE width {' '.join(f'WHEN {k} THEN {_hashes("w", k)}' for k in range(1, WIDTH + 1))} END) AS (at, hash)")))
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = _with_shingle(texts, _rarest(shingles, similarity), widths)
    widths = widths or [WIDTH]

    worded = hits.select("row", F.expr(WORDS).alias("words"))
    placed = worded.select("row", F.size("words").alias("n"), F.expr(f"inline(array({', '.join(f'struct({k} AS width, {_hashes("words", k)} AS hashes)' for k in widths)}))"))
    counted = shingles.groupBy("hash", "width", "item", "length").agg(F.count("*").cast("int").alias("c"))
    anchors = placed.selectExpr("row", "n", "width", "posexplode(hashes) AS (place, hash)").join(small(cut(counted), BROADCAST_ROWS), ["hash", "width"])
    runs = cut(_runs(anchors, similarity))
    iw = small(items.select("item", "item_id", F.col("w").alias("iw")), BROADCAST_ROWS)

    def scored(starts: DataFrame) -> DataFrame:
        windows = starts.join(worded, "row").selectExpr("row", "item", "start", "hashed", "width", "slice(words, start + 1, length) AS v")
        return _scored(windows.join(iw, "item"))

    # the count by hashes is that of the words, but for hashes that stand for several shingles: then all starts are built
    best = runs.groupBy("row", "item", "length", "width").agg(F.max(F.struct("hashed", (-F.col("start")).alias("back"))).alias("m"))
    first = cut(scored(best.selectExpr("row", "item", "length", "width", "-m.back AS start", "m.hashed AS hashed")))
    agreed = first.filter("abs(similarity - hashed) < 1e-9")
    again = first.filter("abs(similarity - hashed) >= 1e-9").select("row", "item").distinct()
    found = agreed if again.isEmpty() else agreed.unionByName(scored(runs.join(again, ["row", "item"], "left_semi").withColumn("start", F.explode(F.expr("sequence(start, until - 1)")))))
    named = found.filter(F.col("similarity") >= similarity).join(hits.select("row", "doc_id"), "row")
    top = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("m"))
    return top.select("doc_id", "item_id", "m.similarity", (-F.col("m.back")).cast("long").alias("start"), F.col("m.n").cast("long").alias("n_words"))


def _runs(anchors: DataFrame, similarity: float) -> DataFrame:
    """(row, item, length, width, start, until, hashed): runs of window starts (``until`` not included) whose
    similarity by shingle hashes is ``hashed``, at least ``similarity``.

    A place of a shingle that the item has c times counts from the start after the c-th place before
    it to the place itself: of equal shingles in a window, the first c count.
    """
    by = ["row", "item", "n", "length", "width"]
    placed = anchors.repartition("row", "item").groupBy(*by, "hash", "c").agg(F.sort_array(F.collect_list("place")).alias("places"))
    last = "greatest(n - length, 0)"
    spans = placed.selectExpr(*by, f"inline(transform(places, (p, i) -> struct(greatest(coalesce(get(places, i - c), -1) + 1, p - length + width, 0) AS lo, least(p, {last}) AS hi)))").filter("lo <= hi")
    ends = spans.selectExpr(*by, "inline(array(struct(lo AS start, 1L AS d), struct(hi + 1 AS start, -1L AS d)))").groupBy(*by, "start").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("row", "item", "n", "length", "width").orderBy("start")
    sums = ends.withColumns({"shared": F.sum("d").over(order), "until": F.lead("start").over(order)}).filter("shared > 0")
    both = F.expr("least(n, length) + length - 2 * (width - 1)") - F.col("shared")
    return sums.withColumn("hashed", F.col("shared") / both).filter(F.col("hashed") >= similarity).select("row", "item", "length", "width", "start", "until", "hashed")


def _scored(near: DataFrame) -> DataFrame:
    """(row, item, item_id, start, n, hashed, similarity): the exact weighted similarity of each window ``v`` and item ``iw``."""
    parts = "transform(sequence(0, greatest(size({0}) - width, 0)), i -> concat_ws(' ', slice({0}, i + 1, width)))"
    sides = near.select("row", "item", "item_id", "start", "hashed", F.size("v").alias("n"), F.expr(f"transform({parts.format('v')}, x -> struct(x AS s, 1L AS a, 0L AS b))").alias("mine"), F.expr(f"transform({parts.format('iw')}, x -> struct(x AS s, 0L AS a, 1L AS b))").alias("theirs"))
    by = ["row", "item", "item_id", "start", "n", "hashed"]
    counts = sides.select(*by, F.explode(F.concat("mine", "theirs")).alias("p")).groupBy(*by, "p.s").agg(F.sum("p.a").alias("a"), F.sum("p.b").alias("b"))
    return counts.groupBy(*by).agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity"))


def _same(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that some item contaminates; columns may have any name.

    Rows are named by identifier and text together, so an identifier that stands for several texts
    loses only the contaminated ones.
    """
    named = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), _same(text_col).alias("same")).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = cut(contaminated(named, benchmark, **options).select("doc_id.id", "doc_id.same").distinct())
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col(f"`{id_col}`").alias("_id"), _same(text_col).alias("_same"))
    out = plain.join(small(found, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_same") == F.col("same")), "left_anti")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
