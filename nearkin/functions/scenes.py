"""Synthetic gray scenes and what second frames of them look like, as column expressions.

Noise is that of a linear congruential sequence. Its i-th number is found by jumping ahead: the step, done
2^k times, is again a step of that kind, so a number takes as many steps as its place has binary digits, and every
pixel is made alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier and increment of the sequence, modulo 2^32; the brightness of the block of a scene.
MULTIPLIER, INCREMENT, MASK = 1664525, 1013904223, (1 << 32) - 1
BLOCK, SLOPE = 220, 90


def scene(width: int, height: int, variant: Column) -> Column:
    """Pixels, row by row: a slope to the right and downwards with a bright block, which ``variant`` moves to the right."""
    x0 = F.lit(width // 8) + variant * F.lit(width // 6)
    y0, y1 = height // 8, height // 8 + height // 4

    def pixel(i: Column) -> Column:
        x, y = i % width, F.floor(i / width).cast("int")
        slope = F.floor(x * SLOPE / max(1, width - 1)) + F.floor(y * SLOPE / max(1, height - 1))
        return F.when((x >= x0) & (x < x0 + width // 4) & (y >= y0) & (y < y1), BLOCK).otherwise(slope).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def brighter(pixels: Column, by: int) -> Column:
    return F.transform(pixels, lambda p: F.least(F.lit(255), p + by))


def _step(state: Column, multiplier: Column, increment: Column) -> Column:
    """One step modulo 2^32; halves of the state, so that no product passes 63 bits."""
    low, high = state.bitwiseAND(F.lit(65535)), F.shiftright(state, 16)
    upper = F.shiftleft((high * multiplier).bitwiseAND(F.lit(65535)), 16)
    return (low * multiplier + upper + increment).bitwiseAND(F.lit(MASK))


def lcg(seed: Column, steps: Column, most: int) -> Column:
    """The number after ``steps`` steps (at most ``most``) from ``seed``."""
    jumps, a, c = [], MULTIPLIER, INCREMENT
    for k in range(most.bit_length()):
        jumps.append(F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")))
        a, c = a * a & MASK, (a * c + c) & MASK
    jump = lambda state, j: F.when(steps.bitwiseAND(j["bit"]) != 0, _step(state, j["a"], j["c"])).otherwise(state)
    return F.aggregate(F.array(*jumps), seed.cast("long").bitwiseAND(F.lit(MASK)), jump)


def noisy(pixels: Column, size: int, amplitude: int, seed: Column) -> Column:
    """Each of ``size`` pixels changed by up to ``amplitude``, by the sequence from ``seed``."""

    def pixel(p: Column, i: Column) -> Column:
        delta = F.shiftright(lcg(seed, i.cast("long") + 1, size), 16) % (2 * amplitude + 1) - amplitude
        return F.greatest(F.lit(0), F.least(F.lit(255), p + delta)).cast("int")

    return F.transform(pixels, pixel)


def blurred(pixels: Column, width: int, height: int) -> Column:
    """Inner pixels as the mean of themselves and their four neighbours."""

    def pixel(p: Column, i: Column) -> Column:
        x, y = i % width, F.floor(i / width).cast("int")
        at = lambda by: F.get(pixels, i + by)
        inner = (x > 0) & (x < width - 1) & (y > 0) & (y < height - 1)
        return F.when(inner, F.floor((p + at(-1) + at(1) + at(-width) + at(width)) / 5).cast("int")).otherwise(p)

    return F.transform(pixels, pixel)


def shifted(pixels: Column, width: int, height: int, dx: Column, dy: Column) -> Column:
    """Moved to the right by ``dx`` and down by ``dy``; what was outside is black."""

    def pixel(_: Column, i: Column) -> Column:
        x, y = i % width - dx, F.floor(i / width).cast("int") - dy
        inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        return F.when(inside, F.get(pixels, (y * width + x).cast("int"))).otherwise(0)

    return F.transform(pixels, pixel)


#: Frames of each moment of the sample library, and whether the last one is out of focus; single photos.
MOMENTS = ((4, True), (3, True), (2, False), (5, True), (2, False), (3, False))
SINGLES = 8


def textured(width: int, height: int, seed: Column) -> Column:
    """Pixels of a picture that ``seed`` decides: waves of several lengths and directions, so that no two neighbouring regions are alike."""
    number = lambda k, n: lcg(seed * 2654435 + 1, F.lit(k).cast("long"), 64) % n
    waves = F.array(*[F.struct((number(5 * k + 1, 100) / 25.0 - 2).alias("x"), (number(5 * k + 2, 100) / 25.0 - 2).alias("y"), (number(5 * k + 3, 628) / 100.0).alias("phase"), (12 + number(5 * k + 4, 30)).alias("size")) for k in range(6)])

    def picture(all_waves: Column) -> Column:
        def pixel(i: Column) -> Column:
            x, y = (i % width) * (6.2832 / width), F.floor(i / width) * (6.2832 / height)
            total = F.aggregate(all_waves, F.lit(128.0), lambda sum_, w: sum_ + w["size"] * F.sin(x * w["x"] + y * w["y"] + w["phase"]))
            return F.greatest(F.lit(0), F.least(F.lit(255), total.cast("int")))

        return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)

    # bound once, so that the waves are found once a picture and not once a pixel
    return F.get(F.transform(F.array(waves), picture), 0)
