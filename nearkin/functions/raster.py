"""Gray rasters as row-major integer arrays: box downscale, difference hash, Laplacian variance.

The column forms take SQL expressions for the pixel array, width and height and stay in the JVM.
The array forms do the same on numpy arrays, for decoded images. A raster is valid if both sides
are positive and the array has width times height pixels; an invalid one counts as empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the grid of the difference hash, wide and high.
GRID_WIDTH, GRID_HEIGHT = 9, 8


def _valid(pixels: str, width: str, height: str) -> str:
    return f"coalesce({width} > 0 AND {height} > 0 AND size({pixels}) = {width} * {height}, false)"


def box_downscale_sql(pixels: str, width: str, height: str, to_width: int, to_height: int) -> str:
    """The box means, rounded down, of ``to_width`` times ``to_height`` cells; empty for an empty raster."""
    if to_width <= 0 or to_height <= 0:
        return "cast(array() AS array<int>)"

    def edge(side: str, at: str, of: int) -> str:
        return f"cast(({at}) * {side} div {of} AS int)"

    y, x = f"cast(i div {to_width} AS int)", f"i % {to_width}"
    y0, x0 = edge(height, y, to_height), edge(width, x, to_width)
    y1 = f"least({height}, greatest({y0} + 1, {edge(height, f'{y} + 1', to_height)}))"
    x1 = f"least({width}, greatest({x0} + 1, {edge(width, f'{x} + 1', to_width)}))"
    rows = f"transform(sequence(b.y0, b.y1 - 1), r -> slice({pixels}, r * {width} + b.x0 + 1, b.x1 - b.x0))"
    cell = f"cast(aggregate(flatten({rows}), 0L, (s, p) -> s + p) div ((b.y1 - b.y0) * (b.x1 - b.x0)) AS int)"
    boxes = f"transform(sequence(0, {to_width * to_height - 1}), i -> struct({y0} AS y0, {y1} AS y1, {x0} AS x0, {x1} AS x1))"
    return f"if({_valid(pixels, width, height)}, transform({boxes}, b -> {cell}), cast(array() AS array<int>))"


def grid_hash_sql(grid: str) -> str:
    """Bit 8y+x is set if cell (x, y) of a 9 by 8 grid is brighter than its right neighbour; 0 for an empty grid."""
    at = f"cast(i div {GRID_WIDTH - 1} AS int) * {GRID_WIDTH} + i % {GRID_WIDTH - 1}"
    fold = f"aggregate(sequence(0, 63), 0L, (a, i) -> a | if(get(g, {at}) > get(g, {at} + 1), shiftleft(1L, i), 0L))"
    return f"get(transform(array({grid}), g -> if(size(g) = {GRID_WIDTH * GRID_HEIGHT}, {fold}, 0L)), 0)"


def difference_hash_sql(pixels: str, width: str, height: str) -> str:
    return grid_hash_sql(box_downscale_sql(pixels, width, height, GRID_WIDTH, GRID_HEIGHT))


def laplacian_variance_sql(pixels: str, width: str, height: str) -> str:
    """Population variance of the four-neighbour Laplacian over inner pixels; 0 for rasters under 3 by 3."""
    p = f"{pixels}[cast(i AS int) + {{0}}]"
    centre = f"(y * {width} + x)"
    inner = f"flatten(transform(sequence(1, {height} - 2), y -> transform(sequence(1, {width} - 2), x -> {centre})))"
    value = f"{p.format(f'(-{width})')} + {p.format(width)} + {p.format('(-1)')} + {p.format('1')} - 4 * {p.format('0')}"
    values = f"transform({inner}, i -> cast({value} AS bigint))"
    sums = f"aggregate({values}, struct(0L AS s, 0L AS q, 0L AS n), (a, r) -> struct(a.s + r AS s, a.q + r * r AS q, a.n + 1 AS n))"
    mean = "(cast(t.s AS double) / t.n)"
    variance = f"get(transform(array({sums}), t -> greatest(0D, cast(t.q AS double) / t.n - {mean} * {mean})), 0)"
    return f"if({_valid(pixels, width, height)} AND {width} >= 3 AND {height} >= 3, {variance}, 0D)"


def box_downscale(pixels: str, width: str, height: str, to_width: int, to_height: int) -> Column:
    return F.expr(box_downscale_sql(pixels, width, height, to_width, to_height))


def difference_hash(pixels: str, width: str, height: str) -> Column:
    return F.expr(difference_hash_sql(pixels, width, height))


def laplacian_variance(pixels: str, width: str, height: str) -> Column:
    return F.expr(laplacian_variance_sql(pixels, width, height))


def np_box_downscale(image: np.ndarray, to_width: int, to_height: int) -> np.ndarray:
    """Box means of a 2-D array by an integral image."""
    h, w = image.shape if image.ndim == 2 else (0, 0)
    if not (h and w and to_width > 0 and to_height > 0):
        return np.zeros((0, 0), np.uint8)
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    y0, x0 = np.arange(to_height) * h // to_height, np.arange(to_width) * w // to_width
    y1 = np.minimum(h, np.maximum(y0 + 1, (np.arange(to_height) + 1) * h // to_height))
    x1 = np.minimum(w, np.maximum(x0 + 1, (np.arange(to_width) + 1) * w // to_width))
    sums = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    return (sums // ((y1 - y0)[:, None] * (x1 - x0)[None, :])).astype(np.uint8)


def np_difference_hash(image: np.ndarray) -> int:
    """The difference hash as a signed 64-bit number."""
    grid = np_box_downscale(image, GRID_WIDTH, GRID_HEIGHT)
    if not grid.size:
        return 0
    bits = (grid[:, :-1] > grid[:, 1:]).reshape(-1)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def np_laplacian_variance(image: np.ndarray) -> float:
    if image.ndim != 2 or min(image.shape) < 3:
        return 0.0
    p = image.astype(np.int64)
    r = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    mean = float(r.sum()) / r.size
    return max(0.0, float((r * r).sum()) / r.size - mean * mean)
