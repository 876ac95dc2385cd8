"""Capture times from the bytes of JPEG files.

A capture time is a struct of six integers, not a timestamp: a day that its month lacks and second
60 are accepted. Anything malformed gives no date.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("year", "month", "day", "hour", "minute", "second")
DATE_TYPE = f"struct<{','.join(f'{k}:int' for k in PARTS)}>"
#: Tags, the text type, the length of a date text and of a directory entry, prefix read.
TAG_DATETIME, TAG_SUB_IFD, TAG_ORIGINAL, TAG_DIGITIZED, TAG_ORIENTATION = 0x0132, 0x8769, 0x9003, 0x9004, 0x0112
ASCII, DATE_LENGTH, ENTRY = 2, 19, 12
PREFIX_BYTES = 131072
#: Fixed values as hex digits: markers that end the walk, markers without a length, that of Exif segments and how
#: their payload starts, and how a TIFF block of either byte order starts.
ENDS, BARE, APP1, EXIF = ("DA", "D9"), ("01", "D0", "D1", "D2", "D3", "D4", "D5", "D6", "D7"), "E1", "457869660000"
LITTLE, BIG = "49492A00", "4D4D002A"

#: Integers of at most 4 and 2 characters, sign included, as a C text scan reads them.
_DATE = re.compile(
    rb"\s*+([+-]\d{1,3}+|\d{1,4}+):\s*+([+-]\d|\d{1,2}+):\s*+([+-]\d|\d{1,2}+)\s*+([+-]\d|\d{1,2}+):\s*+([+-]\d|\d{1,2}+):\s*+([+-]\d|\d{1,2}+)"
)

Date = tuple[int, int, int, int, int, int]


def parse_date(text: bytes) -> Date | None:
    """A date text, if its fields are in range: from 1826 on, second 60 included."""
    m = _DATE.match(text)
    if not m:
        return None
    y, mo, d, h, mi, s = date = tuple(map(int, m.groups()))
    return date if y >= 1826 and 1 <= mo <= 12 and 1 <= d <= 31 and 0 <= h <= 23 and 0 <= mi <= 59 and 0 <= s <= 60 else None


class _Tiff:
    """Bounds-checked reads of a TIFF block in its byte order."""

    def __init__(self, data: bytes, order: str) -> None:
        self.data, self.order = data, order

    def number(self, at: int, size: int) -> int | None:
        if at < 0 or at + size > len(self.data):
            return None
        return struct.unpack_from(self.order + ("H" if size == 2 else "I"), self.data, at)[0]

    def entries(self, at: int):
        """(tag, type, count, place of the value) of a directory; none if it does not fit."""
        n = self.number(at, 2)
        if n is None or at + 2 + n * ENTRY > len(self.data):
            return
        for i in range(n):
            e = at + 2 + i * ENTRY
            yield self.number(e, 2), self.number(e + 2, 2), self.number(e + 4, 4), e + 8

    def date(self, kind: int, count: int, at: int) -> Date | None:
        if kind != ASCII or count < DATE_LENGTH:
            return None
        start = self.number(at, 4)
        if start is None or start + DATE_LENGTH > len(self.data):
            return None
        return parse_date(self.data[start : start + DATE_LENGTH])


def _tiff(data: bytes) -> tuple[_Tiff, int] | None:
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        return None
    tiff = _Tiff(data, "<" if data[:2] == b"II" else ">")
    first = tiff.number(4, 4)
    return (tiff, first) if tiff.number(2, 2) == 42 and first < len(data) else None


def _date_of(block: bytes) -> Date | None:
    if (found := _tiff(block)) is None:
        return None
    tiff, first = found
    plain, pointer = None, 0
    for tag, kind, count, at in tiff.entries(first):
        if tag == TAG_DATETIME:
            plain = tiff.date(kind, count, at)
        elif tag == TAG_SUB_IFD:
            pointer = tiff.number(at, 4)
    original = digitized = None
    if 0 < pointer < len(block):
        for tag, kind, count, at in tiff.entries(pointer):
            if tag == TAG_ORIGINAL:
                original = tiff.date(kind, count, at) or original
            elif tag == TAG_DIGITIZED:
                digitized = tiff.date(kind, count, at)
    return original or digitized or plain


def _exif_block(data: bytes | None) -> bytes | None:
    """The TIFF block of the first Exif segment of a JPEG file."""
    if data is None or len(data) < 4 or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return None
        marker = data[at]
        at += 1
        if marker in (0xDA, 0xD9):
            return None
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        if at + 2 > len(data):
            return None
        length = int.from_bytes(data[at : at + 2], "big")
        if length < 2 or at + length > len(data):
            return None
        payload = data[at + 2 : at + length]
        if marker == 0xE1 and len(payload) > 6 and payload[:6] == b"Exif\0\0":
            return payload[6:]
        at += length
    return None


def read_date(data: bytes | None) -> Date | None:
    """The capture time in the bytes of a JPEG file (a prefix is enough)."""
    block = _exif_block(data)
    return None if block is None else _date_of(block)


def read_orientation(data: bytes | None) -> int:
    """The orientation tag of a JPEG file, 1 to 8; 1 if there is none."""
    block = _exif_block(data)
    if block is None or (found := _tiff(block)) is None:
        return 1
    tiff, first = found
    for tag, _, _, at in tiff.entries(first):
        if tag == TAG_ORIENTATION:
            value = tiff.number(at, 2)
            return value if value is not None and 1 <= value <= 8 else 1
    return 1


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _hex(data: Column, at: Column, size: int) -> Column:
    return F.hex(F.substring(data, at + 1, F.lit(size)))


def _exif_place(data: Column) -> Column:
    """(start, size) of the TIFF block of the first Exif segment; a size of -1 if there is none.

    A state machine over places: each step takes a fill byte or a segment. Steps come in tiers, so that files with
    few segments, which is nearly all, take few; the last tier has a step for each byte, which is always enough.
    """
    length = F.length(data)

    def state(at: Column, filled: bool, ended: bool = False, start: Column | None = None, size: Column | None = None) -> Column:
        found = (F.lit(-1) if start is None else start).alias("start"), (F.lit(-1) if size is None else size).alias("size")
        return F.struct(at.alias("at"), F.lit(filled).alias("filled"), F.lit(ended).alias("ended"), *found)

    def step(s: Column, _: Column) -> Column:
        at, end = s["at"], state(s["at"], False, True)
        marker = _hex(data, at, 1)
        said = F.conv(_hex(data, at + 1, 2), 16, 10).cast("int")
        return (
            F.when(s["ended"], s)
            .when(~s["filled"] & ((at + 4 > length) | (marker != "FF")), end)
            .when(at >= length, end)
            .when(marker == "FF", state(at + 1, True))
            .when(marker.isin(*ENDS), end)
            .when(marker.isin(*BARE), state(at + 1, False))
            .when((at + 3 > length) | (said < 2) | (at + 1 + said > length), end)
            .when((marker == APP1) & (said > 8) & (_hex(data, at + 3, 6) == EXIF), state(at, False, True, at + 9, said - 8))
            .otherwise(state(at + 1 + said, False))
        )

    steps = F.array(F.lit(64), F.lit(2048), length)
    walk = F.aggregate(steps, state(F.lit(2), False), lambda s, n: F.when(s["ended"], s).otherwise(F.aggregate(F.sequence(F.lit(1), n), s, step)))
    starts = (length >= 4) & (_hex(data, F.lit(0), 2) == "FFD8")
    return F.when(starts, walk).otherwise(state(F.lit(0), False, True))


class _Block:
    """Reads of a TIFF block as expressions: null beyond its ends."""

    def __init__(self, data: Column, little: Column) -> None:
        self.data, self.little, self.length = data, little, F.length(data).cast("long")

    def number(self, at: Column, size: int) -> Column:
        digits = F.when((at >= 0) & (at + size <= self.length), _hex(self.data, at.cast("int"), size))
        turned = lambda h: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])
        return let(digits, lambda h: F.conv(F.when(self.little, turned(h)).otherwise(h), 16, 10).cast("long"))

    def entries(self, at: Column, *tags: int) -> Column:
        """The (tag, at) of a directory's entries with these tags, in their order; null if it has none or does not fit."""
        entry = lambda i: let(at + 2 + i * ENTRY, lambda e: F.struct(self.number(e, 2).alias("tag"), e.alias("at")))
        of = lambda n: F.when((n > 0) & (at + 2 + n * ENTRY <= self.length), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), entry))
        return F.filter(let(self.number(at, 2), of), lambda e: e["tag"].isin(*tags))

    def date(self, at: Column) -> Column:
        """The date of an entry, null if it is none."""
        told = (self.number(at + 2, 2) == ASCII) & (self.number(at + 4, 4) >= DATE_LENGTH)
        text = lambda start: F.when(start + DATE_LENGTH <= self.length, F.substring(self.data, start.cast("int") + 1, F.lit(DATE_LENGTH)))
        return F.when(told, let(self.number(at + 8, 4), lambda start: let(text(start), date_of_text)))


def date_of_text(text: Column) -> Column:
    """The struct of a date text (binary), as ``parse_date`` reads it."""
    # the separator is no byte, so only texts that match have six parts
    parts = F.split(F.regexp_replace(F.decode(text, "ISO-8859-1"), f"^{_DATE.pattern.decode()}[\\s\\S]*$", "\u0100".join(f"${i}" for i in range(1, 7))), "\u0100")

    def checked(p: Column) -> Column:
        y, mo, d, h, mi, s = (p[i] for i in range(6))
        valid = (y >= 1826) & mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 60)
        return F.when(valid, F.struct(*[p[i].alias(k) for i, k in enumerate(PARTS)]))

    return let(parts, lambda p: F.when(F.size(p) == 6, let(F.transform(p, lambda x: x.cast("int")), checked)))


def _of_block(data: Column, then: Callable[[_Block, Column], Column]) -> Column:
    """``then`` of the TIFF block in the bytes of a JPEG file and the place of its first directory; null without one."""

    def of(block: Column) -> Column:
        order = _hex(block, F.lit(0), 4)
        tiff = _Block(block, order == LITTLE)
        first = F.when(order.isin(LITTLE, BIG) & (tiff.length >= 8), tiff.number(F.lit(4).cast("long"), 4))
        return let(first, lambda at: F.when(at < tiff.length, then(tiff, at)))

    cut = lambda d: let(_exif_place(d), lambda s: let(F.when(s["size"] > 0, F.substring(d, s["start"] + 1, s["size"])), of))
    return let(F.substring(data, 1, PREFIX_BYTES), cut)


def exif_date(data: Column) -> Column:
    """The capture time of JPEG bytes as a struct; a null struct if there is none.

    As ``read_date``, but an expression: the segments of the prefix are walked by ``aggregate``, and directories are
    arrays of entries. Of equal tags the last one counts, of original times the last valid one.
    """
    last = lambda rows: F.try_element_at(rows, F.lit(-1))
    tagged = lambda rows, tag: F.filter(rows, lambda e: e["tag"] == tag)

    def dates(tiff: _Block, first: Column) -> Column:
        def captured(rows: Column) -> Column:
            originals = F.filter(F.transform(tagged(rows, TAG_ORIGINAL), lambda e: tiff.date(e["at"])), lambda d: d.isNotNull())
            return F.coalesce(last(originals), tiff.date(last(tagged(rows, TAG_DIGITIZED))["at"]))

        def of(rows: Column) -> Column:
            pointer = tiff.number(last(tagged(rows, TAG_SUB_IFD))["at"] + 8, 4)
            within = lambda at: F.when((at > 0) & (at < tiff.length), let(tiff.entries(at, TAG_ORIGINAL, TAG_DIGITIZED), captured))
            return F.coalesce(let(pointer, within), tiff.date(last(tagged(rows, TAG_DATETIME))["at"]))

        return let(tiff.entries(first, TAG_DATETIME, TAG_SUB_IFD), of)

    return _of_block(data, dates)


def exif_orientation(data: Column) -> Column:
    """The orientation tag of JPEG bytes, 1 to 8; 1 if there is none: ``read_orientation`` as an expression."""
    value = _of_block(data, lambda tiff, first: tiff.number(F.try_element_at(tiff.entries(first, TAG_ORIENTATION), F.lit(1))["at"] + 8, 2))
    return let(value, lambda v: F.when(v.between(1, 8), v).otherwise(1).cast("int"))


def format_date(date: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS; null for no date."""
    parts = [date[k] for k in PARTS]
    return F.when(date.isNotNull(), F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *parts))
