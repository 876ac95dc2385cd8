"""A 64-bit signature of a text: its words, dealt over a 9 by 8 grid, hashed like an image."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions.raster import GRID_HEIGHT, GRID_WIDTH

CELLS = GRID_WIDTH * GRID_HEIGHT


def cells_of(words: list[bytes]) -> np.ndarray:
    """The cell of each word, by the first two bytes of its MD5; an empty one, as between two spaces, has the place after all cells."""
    starts = np.frombuffer(b"".join([hashlib.md5(w).digest()[:2] for w in words]), ">u2") % CELLS
    return np.where([bool(w) for w in words], starts, CELLS).astype(np.int64)


def text_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, cells, words, columns to keep) of each row: its words in each of the 72 cells, and how many different ones; null for a null text.

    Words are what stands between spaces and line ends, in lower case; each is hashed once a batch.
    """
    kinds = dict(docs.dtypes)
    others = "".join(f", `{k}` {kinds[k]}" for k in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1), batch.num_rows
            words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            owner = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.list_flatten(words).dictionary_encode()
            known = cells_of(coded.dictionary.cast(pa.binary()).to_pylist())
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = known[code]
            counts = np.bincount(owner * (CELLS + 1) + at, minlength=rows * (CELLS + 1)).reshape(rows, CELLS + 1)[:, :CELLS]
            # one place for each pair of a row and a word of it
            pairs = pa.array((owner * len(known) + code)[at < CELLS]).unique().to_numpy()
            different = np.bincount(pairs // max(1, len(known)), minlength=rows)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * CELLS), pa.array(counts.reshape(-1).astype(np.int32)))
            words = pa.array(different, pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells, words, *batch.columns[2:]], names=["id", "cells", "words", *kept])

    return docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"), *kept).mapInArrow(run, f"id {kinds[id_col]}, cells array<int>, words long{others}")


def cell_signatures(cells: DataFrame, *kept: str) -> DataFrame:
    """(id, hash) from (id, cells): one row per identifier, whose rows' cells are added up. With columns to keep, (id, hash, these) for each row."""
    lists = cells.groupBy("id").agg(F.collect_list("cells").alias("all"), *[F.collect_list(F.struct(*kept)).alias("rows")] * bool(kept))
    summed = lists.select("id", *["rows"] * bool(kept), F.expr("if(size(all) = 1, all[0], aggregate(all, array_repeat(0L, size(all[0])), (a, x) -> zip_with(a, x, (p, q) -> p + q)))").alias("m"))
    # a cell is brighter than the one to its right
    bit = f"if(p % {GRID_WIDTH} < {GRID_WIDTH - 1} AND n > get(m, p + 1), shiftleft(1L, cast(p div {GRID_WIDTH} * {GRID_WIDTH - 1} + p % {GRID_WIDTH} AS int)), 0L)"
    return summed.select("id", F.expr(f"aggregate(transform(m, (n, p) -> {bit}), 0L, (a, b) -> a | b)").alias("hash"), *[F.inline("rows")] * bool(kept))


def text_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash): one row per identifier; a text without words has hash 0.

    Words are counted per cell before anything is shuffled, so a document sends 72 numbers at most.
    """
    return cell_signatures(text_cells(docs, id_col, text_col).drop("words"))
