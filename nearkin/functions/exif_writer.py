"""JPEG files that hold nothing but an Exif block, as column expressions: the counterpart of ``exif``.

Directories, their entries and all offsets follow from the values, row by row: an entry's value stands in
the entry if it takes no more than four bytes, else behind the directories at an even place.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearkin.functions.exif import ENTRY, TAG_SUB_IFD, let

#: Kinds of entries, and the most bytes that a segment can say it has.
ASCII, SHORT, LONG = 2, 3, 4
MOST = 65535


@dataclass(frozen=True)
class Entry:
    """A tag with a value: text for ASCII (a null byte is added), a number for SHORT and LONG."""

    tag: int
    kind: int
    value: Column


def _number(value: Column, size: int, little: bool) -> Column:
    """``size`` bytes of a number as hex digits in a byte order."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size)][:: -1 if little else 1])


def _directory(entries: list[Entry], at: Column, pointer: Column | None, little: bool) -> tuple[Column, Column, Column]:
    """(entries, values behind them, where they end) of a directory at ``at``, as hex digits, as its texts are; ``pointer`` is that of the next one."""
    n = len(entries) + (pointer is not None)
    place = at + F.lit(2 + n * ENTRY + 4)
    parts, values = [], []
    number = lambda x, size: _number(x if isinstance(x, Column) else F.lit(x), size, little)
    for e in entries:
        head = [number(e.tag, 2), number(e.kind, 2)]
        if e.kind != ASCII:
            size = 2 if e.kind == SHORT else 4
            parts += [*head, number(1, 4), F.rpad(number(e.value, size), 8, "0")]
            continue
        text = e.value
        count = (F.length(text) / 2).cast("long")
        held = count <= 4
        padded = F.when(held, "").otherwise(F.concat(text, F.when(count % 2 == 1, "00").otherwise("")))
        parts += [*head, number(count, 4), F.when(held, F.rpad(text, 8, "0")).otherwise(number(place, 4))]
        values.append(padded)
        place = place + (F.length(padded) / 2).cast("long")
    if pointer is not None:
        parts += [number(TAG_SUB_IFD, 2), number(LONG, 2), number(1, 4), number(pointer, 4)]
    return F.concat(number(n, 2), *parts, number(0, 4)), F.concat(F.lit(""), *values), place


def _size(hexed: Column) -> Column:
    return (F.length(hexed) / 2).cast("long")


def exif_jpeg(main: list[Entry], capture: list[Entry] = (), little: bool = True) -> Column:
    """The bytes of a JPEG file with these entries in its main directory and in its capture directory.

    Entries are written by tag, as the format wants. A null value, or more bytes than a segment can hold, gives null.
    """
    rows, sub = ([replace(e, value=_hexed(e)) for e in sorted(part, key=lambda e: e.tag)] for part in (main, capture))

    # values are bound once: every offset names those before it, and as one generated method this outgrows the JVM's limit
    def of(values: Column) -> Column:
        bound = [replace(e, value=values[f"v{i}"]) for i, e in enumerate(rows + sub)]
        return _file(bound[: len(rows)], bound[len(rows) :], little)

    return F.unhex(let(F.struct(*[e.value.alias(f"v{i}") for i, e in enumerate(rows + sub)]), of)) if rows + sub else F.unhex(_file([], [], little))


def _hexed(entry: Entry) -> Column:
    """The bytes of a text and its null byte as hex digits; other values as they are."""
    return F.concat(F.hex(F.encode(entry.value, "UTF-8")), F.lit("00")) if entry.kind == ASCII else entry.value.cast("long")


def _file(rows: list[Entry], capture: list[Entry], little: bool) -> Column:
    """The hex digits of the file of entries by tag whose texts are hex digits already."""
    start = F.lit(8).cast("long")
    # the capture directory begins where the main one's values end, which does not depend on the pointer to it
    end = _directory(rows, start, start if capture else None, little)[2]

    def payload(end: Column) -> Column:
        head, values, _ = _directory(rows, start, end if capture else None, little)
        tiff = [F.lit("49492A00" if little else "4D4D002A"), _number(start, 4, little), head, values]
        if capture:
            tiff += _directory(capture, end, None, little)[:2]
        return F.concat(F.lit("457869660000"), *tiff)

    def file(payload: Column) -> Column:
        length = _size(payload) + 2
        return F.when(length <= MOST, F.concat(F.lit("FFD8FFE1"), _number(length, 2, False), payload, F.lit("FFD9")))

    return let(let(end, payload), file)
