"""64-bit hashes as signed longs: popcount, Hamming distance, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits, bands and bits per band of a hash; the largest threshold that bands cover.
HASH_BITS, BANDS, BAND_BITS, MAX_THRESHOLD = 64, 8, 8, 7
DEFAULT_THRESHOLD = 3


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_value(x: Column, band: Column | int) -> Column:
    """Bits 8*band to 8*band+7 of the hash."""
    shift = F.lit(band) * BAND_BITS if isinstance(band, int) else band * BAND_BITS
    return F.call_function("shiftrightunsigned", x, shift.cast("int")).bitwiseAND(F.lit(255))


def signed(bits: int) -> int:
    """The long that has these 64 bits."""
    return bits - (1 << 64) if bits >> 63 else bits


def clamp_threshold(threshold: int) -> int:
    return max(0, min(threshold, MAX_THRESHOLD))


def hash_hex(x: Column) -> Column:
    """The hash as 16 unsigned hex digits."""
    return F.lower(F.lpad(F.hex(x), 16, "0"))
