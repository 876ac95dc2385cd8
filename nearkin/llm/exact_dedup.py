"""Exact dedup by content sort (DataFrame functions only).

Sampled splitters deal the rows into ranges of their normalised bytes, each range is sorted
externally, so equal texts lie side by side, and each row is compared in full with its left
neighbour. A run of equal texts keeps its best row.

The sort key is (first characters of the normalised text, 64-bit hash of all of it, the text
itself). A splitter goes on with a hash of the identifier, so a text with very many copies is
dealt over several ranges instead of one. Only a text that a splitter names can lie on both sides
of it; such texts (at most one per splitter) are also summed up over all rows, with partial
aggregation, and that small table corrects their runs.

Defined results: a null text is the empty text and all empty texts are equal; texts are compared whole,
however long; a null identifier
loses every tie; of repeated rows one is kept; an empty table gives an empty result. Only the
identifier and text columns and those named in ``carry`` are read, so other columns may have any
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that normalising deletes: [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

PREFIX = 32
SAMPLE_PER_BUCKET = 20
MAX_BUCKETS = 16384


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _order_key(norm: Column, ident: Column) -> Column:
    """One string whose order is that of (prefix, content hash, identifier hash); no line feeds in it."""
    return F.concat(
        F.substring(norm, 1, PREFIX),
        F.lit("\x00"),
        F.lpad(F.hex(F.xxhash64(norm)), 16, "0"),
        F.lpad(F.hex(F.xxhash64(ident)), 16, "0"),
    )


def _splitters(docs: DataFrame, buckets: int, seed: int) -> list[str]:
    """Quantiles of a bounded sample of the order keys."""
    rows = docs.count()
    if buckets < 2 or not rows:
        return []
    sample = docs.sample(False, min(1.0, buckets * SAMPLE_PER_BUCKET / rows), seed)
    keys = sorted(r[0] for r in sample.select(_order_key(normalised(F.col("_text")), F.col("_id"))).limit(4 * buckets * SAMPLE_PER_BUCKET).collect())
    return sorted({keys[i * len(keys) // buckets] for i in range(1, buckets)}) if keys else []


def _bucket(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or below ``key``: a binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    array = F.split(F.lit("\n".join(splitters)), "\n")
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]

    def step(acc: Column, size: Column) -> Column:
        to = acc["at"] + size
        return F.struct(F.when(F.get(array, to - 1) <= acc["key"], to).otherwise(acc["at"]).alias("at"), acc["key"].alias("key"))

    start = F.struct(F.lit(0).alias("at"), key.alias("key"))
    return F.aggregate(F.array(*map(F.lit, steps)), start, step, lambda acc: acc["at"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, buckets: int | None = None, seed: int = 7) -> DataFrame:
    """One row per input row: its group, the row that stays and the digest of the normalised text.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, then those in ``carry`` under ``_c_``
    and their names. Of equal texts the one with the most code points in the original text stays,
    then the smallest identifier. ``buckets``: ranges of the sort, by default eight per shuffle
    partition.
    """
    spark = docs.sparkSession
    carry = carry or []
    buckets = min(MAX_BUCKETS, buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # each column is shuffled once, under one name
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c_{c}") for c in dict.fromkeys([id_col, text_col, *carry])])
    ident, text = F.col(f"`_c_{id_col}`").alias("_id"), F.col(f"`_c_{text_col}`").alias("_text")
    plain = own.select(ident, text)
    splitters = _splitters(plain, buckets, seed)

    key = _order_key(normalised(F.col(f"`_c_{text_col}`")), F.col(f"`_c_{id_col}`"))
    dealt = own.withColumn("_bucket", _bucket(key, splitters)).repartition("_bucket").withColumns({"_id": ident, "_text": text})
    rows = dealt.select(
        "_bucket", "_id", F.char_length(F.coalesce("_text", F.lit(""))).cast("long").alias("_n"), normalised(F.col("_text")).alias("_norm"), *[f"`_c_{c}`" for c in carry]
    ).withColumns({"_prefix": F.substring("_norm", 1, PREFIX), "_hash": F.xxhash64("_norm")})
    order = [F.col("_prefix"), F.col("_hash"), F.col("_norm"), F.col("_n").desc(), F.col("_id").asc_nulls_last()]
    sort = Window.partitionBy("_bucket").orderBy(*order)
    before = F.lag("_norm").over(sort)
    compared = rows.select(
        "_bucket", "_id", "_n", "_hash", "_norm", *[f"`_c_{c}`" for c in carry], F.row_number().over(sort).alias("_at"), (before.isNotNull() & (before == F.col("_norm"))).alias("_same")
    )
    thin = compared.select(
        "_bucket", "_id", "_n", "_hash", "_at", F.when(~F.col("_same"), F.col("_at")).alias("_start"), F.when(~F.col("_same"), F.sha2("_norm", 256)).alias("_sha"), *[f"`_c_{c}`" for c in carry]
    )
    running = Window.partitionBy("_bucket").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = thin.withColumns({c: F.last(c, ignorenulls=True).over(running) for c in ("_start", "_sha")} | {
        "_keep": F.last(F.when(F.col("_start").isNotNull(), F.struct("_id")), ignorenulls=True).over(running)})
    sized = runs.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("_bucket", "_start")))
    if splitters:
        sized = sized.join(F.broadcast(_across(plain, splitters)), "_sha", "left")
    else:
        sized = sized.withColumn("_all", F.lit(None).cast("struct<size:long,n:long,id:long>"))
    first = F.col("_at") == F.col("_start")
    return sized.select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_all").isNotNull(), F.col("_all.id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_all.size", "_size").alias("group_size"),
        (first & (F.col("_all").isNull() | (F.col("_n").eqNullSafe(F.col("_all.n")) & F.col("_id").eqNullSafe(F.col("_all.id"))))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *[f"`_c_{c}`" for c in carry],
    )


def _across(plain: DataFrame, splitters: list[str]) -> DataFrame:
    """Size and best row, over all ranges, of each text that a splitter names: a row per splitter at most."""
    named = sorted({s.rpartition("\x00")[2][:16] for s in splitters})
    norm = plain.select("_id", F.char_length(F.coalesce("_text", F.lit(""))).cast("long").alias("_n"), normalised(F.col("_text")).alias("_norm"))
    some = norm.filter(F.lpad(F.hex(F.xxhash64("_norm")), 16, "0").isin(named))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))
    groups = some.groupBy("_norm").agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
    return groups.select(F.sha2("_norm", 256).alias("_sha"), F.struct("size", (-F.col("best.n")).alias("n"), F.col("best.id").alias("id")).alias("_all"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``; the texts are shuffled once."""
    out = exact_dedup(docs, id_col, text_col, carry=docs.columns)
    return out.filter("kept").select(*[F.col(f"`_c_{c}`").alias(c) for c in docs.columns])
