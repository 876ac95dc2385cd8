"""Vector code compression by product codes over distinct integer parts.

Each component becomes an integer, floor(scale * x), and vectors are cut into ``parts`` consecutive
parts. Equal parts of a position are reduced to one weighted row first (partial aggregation, so a vector that
very many rows share costs a row per task), and Lloyd's rounds run over these distinct rows: each task
finds the nearest entries of its rows as arrays and gives weighted sums, at most one for each entry and
task. The driver sees the sums of the codebooks' entries only, which the parameters bound. In the end each
distinct part's code and error are joined back to the vectors that hold it.

All numbers are integers, so results do not depend on how rows are dealt: distances are exact (in double
precision only while every term is below 2^53), ties go to the lower entry, means are floored.

Defined results: rows whose vector is null, or holds a null or a number that is not finite, go, as
do rows whose vector has another length than that of the smallest identifier's; integers are held
within 2^24 on either side. A length that ``parts`` does not divide gives parts that differ by one. Null
identifiers come last among the first vectors, equal identifiers are ordered by their vectors, and every
row keeps its own row; with fewer than ``entries`` vectors the codebooks are that much smaller; an
entry without parts stays; vectors without components have code 0 and no error; an empty table gives
an empty result. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.runtime import cut, small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers lie within this bound on either side.
LIMIT = 1 << 24
#: Parts that are compared with a codebook at a time.
CHUNK = 2048
#: Most labels that may be broadcast with their sums.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Codes:
    """codes: (id, carried columns as _c_NAME, codes array<int>, error); codebooks: by part, (entries, width) integers."""

    codes: DataFrame
    codebooks: tuple[np.ndarray, ...]

    def digest(self) -> str:
        """SHA-256 of all entries' integers by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for x in book.reshape(-1)).encode()).hexdigest()

    def decode(self, codes: list[int]) -> np.ndarray:
        """The integers that a code stands for."""
        return np.concatenate([book[c] for book, c in zip(self.codebooks, codes, strict=True)])


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, within ``LIMIT``."""
    held = lambda x: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def _usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of ``book`` that is nearest to each row (the first of equals), and the squared distance."""
    at, error = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    top = max(int(np.abs(values).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = 4 * top * top * max(1, book.shape[1]) < 1 << 53
    step = CHUNK if exact else max(1, (1 << 20) // max(1, book.size))
    floats = book.astype(np.float64)
    for i in range(0, len(values), step):
        v = values[i : i + step]
        if exact:
            f = v.astype(np.float64)
            d = (f * f).sum(1)[:, None] - 2 * (f @ floats.T) + (floats * floats).sum(1)[None, :]
        else:
            d = ((v[:, None, :] - book[None, :, :]) ** 2).sum(2)
        at[i : i + step] = d.argmin(1)
        error[i : i + step] = d.min(1)
    return at, error


def _blocks(batch: pa.RecordBatch, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, places in the batch, parts as rows) of a batch whose first columns are pos and part."""
    pos = batch.column(0).to_numpy()
    for p in np.unique(pos):
        at = np.flatnonzero(pos == p)
        flat = batch.column(1).take(pa.array(at)).flatten().to_numpy().astype(np.int64)
        yield int(p), at, flat.reshape(len(at), widths[p])


def _moved(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floored mean of its parts."""
    widths = [b.shape[1] for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), w + 1), np.int64) for b, w in zip(books, widths, strict=True)]
        for batch in batches:
            weights = batch.column(2).to_numpy()
            for p, at, values in _blocks(batch, widths):
                n = weights[at]
                np.add.at(sums[p], nearest(values, books[p])[0], np.column_stack([values * n[:, None], n]))
        rows = [(p, int(c), sums[p][c].tolist()) for p in range(len(books)) for c in np.flatnonzero(sums[p][:, -1])]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64()))], names=["pos", "code", "sums"])

    # a row for each entry and task, then one for each component of the codebooks
    each = distinct.mapInArrow(run, "pos int, code int, sums array<long>").select("pos", "code", F.posexplode("sums").alias("i", "s"))
    total = [np.zeros((len(b), w + 1), object) for b, w in zip(books, widths, strict=True)]
    for r in each.groupBy("pos", "code", "i").agg(F.sum("s").alias("s")).collect():
        total[r["pos"]][r["code"], r["i"]] = r["s"]
    out = []
    for book, sums in zip(books, total, strict=True):
        used = np.flatnonzero(sums[:, -1])
        new = book.copy()
        new[used] = (sums[used, :-1] // sums[used, -1:]).astype(np.int64)
        out.append(new)
    return out


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codebooks learned from all vectors, and each vector's codes and error."""
    carry = carry or []
    plain = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"), *[F.col(f"`{c}`").alias(f"_c_{c}") for c in carry])
    ints = cut(plain.filter(_usable(F.col("v"))).select(F.monotonically_increasing_id().alias("row"), "id", integers(F.col("v"), scale).alias("q"), *[f"`_c_{c}`" for c in carry]))
    first = [F.col("id").asc_nulls_last(), F.col("q")]
    head = ints.orderBy(*first).select("q").first()
    size = 0 if head is None else len(head["q"])
    rows = ints.filter(F.size("q") == size)
    # as many rows as a codebook has entries
    heads = rows.orderBy(*first).select("q").limit(entries).collect()
    seeds = np.array([r["q"] for r in heads], np.int64).reshape(len(heads), size)
    edges = [size * p // parts for p in range(parts + 1)]
    books = [seeds[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)]
    widths = [b.shape[1] for b in books]

    cuts = [F.struct(F.lit(p).alias("pos"), F.slice("q", edges[p] + 1, widths[p]).alias("part")) for p in range(parts)]
    each = rows.select("row", "id", *[f"`_c_{c}`" for c in carry], F.inline(F.array(*cuts)))
    distinct = cut(each.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")))
    if len(seeds):
        for _ in range(rounds):
            books = _moved(distinct, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, values in _blocks(batch, widths):
                codes[at], errors[at] = nearest(values, books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes), pa.array(errors)], names=["pos", "part", "code", "e"])

    coded = distinct.mapInArrow(code, "pos int, part array<int>, code int, e long")
    by = ["row", "id", *[f"`_c_{c}`" for c in carry]]
    whole = each.join(coded, ["pos", "part"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("found"), F.sum("e").alias("error"))
    return Codes(whole.select("id", *by[2:], F.transform("found", lambda x: x["code"]).alias("codes"), "error"), tuple(books))


def code_text(codes: Column) -> Column:
    """Two hex digits for each code, in part order."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")


def code_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together) and codebooks_sha256."""
    found = encode(vectors, id_col, vector_col, [label_col])
    rows = cut(found.codes.select(F.col("id").alias("vec_id"), F.col(f"`_c_{label_col}`").alias("label"), code_text(F.col("codes")).alias("code"), "error"))
    sums = small(cut(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")), BROADCAST_ROWS)
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))
