"""Names, folders and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: endings of photo files, in any case.
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif")


def has_photo_extension(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(PHOTO_EXTENSIONS)})$")


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _last_dot(name: Column) -> Column:
    """The place of the last dot from 1; 0 if there is none or only a leading one."""
    place = F.when(F.instr(name, ".") > 0, F.char_length(name) - F.instr(F.reverse(name), ".") + 1).otherwise(0)
    return F.when(place > 1, place).otherwise(0)


def stem(name: Column) -> Column:
    dot = _last_dot(name)
    return F.when(dot > 0, F.substring(name, F.lit(1), (dot - 1).cast("int"))).otherwise(name)


def extension(name: Column) -> Column:
    """The ending with its dot; empty if there is none."""
    dot = _last_dot(name)
    return F.when(dot > 0, F.substring(name, dot.cast("int"), F.char_length(name))).otherwise("")


def trim_root(root: Column) -> Column:
    """Without separators at its end; a root of one character stays."""
    return F.regexp_replace(root, r"^(.+?)[/\\]+$", "$1")


def destination_folder(root: Column, year: Column, month: Column) -> Column:
    """root/YYYY/YYYY-MM, or root/Undated if there is no year."""
    base = trim_root(root)
    dated = F.concat(base, F.format_string("/%04d/%04d-%02d", year, year, month))
    return F.when(year.isNull(), F.concat(base, F.lit("/Undated"))).otherwise(dated)


def human_size(size: Column) -> Column:
    """Megabytes with one digit from a mebibyte on, else whole kilobytes; halves go to the even digit."""
    # Java's format would round halves up
    return F.when(size >= 1 << 20, F.format_string("%.1f MB", F.bround(size / (1 << 20), 1))).otherwise(F.format_string("%d KB", F.rint(size / 1024).cast("long")))


# The wording of labels and of the summary.
GROUP_LABEL = "Group %d  —  %d photos, %d to remove"
SIZE_LABEL = "%d x %d  ·  %s"
KEEPER_LABEL = "★ sharpest — keep"


def group_label(number: Column, size: Column) -> Column:
    return F.format_string(GROUP_LABEL, number, size, size - 1)


def photo_label(name: Column, width: Column, height: Column, size: Column, date: Column, keeper: Column) -> Column:
    """Name, dimensions and size, the date if known and the keeper's mark, a line each."""
    return F.concat_ws("\n", name, F.format_string(SIZE_LABEL, width, height, human_size(size)), date, F.when(keeper, F.lit(KEEPER_LABEL)))


def summary_text(photos: Column, failed: Column, groups: Column, in_groups: Column, marked: Column, comparisons: Column, naive: Column) -> Column:
    """The scan in one line; parts without a count are left out."""
    return F.concat_ws(
        "  ·  ",
        F.format_string("%d photos scanned", photos),
        F.when(failed > 0, F.format_string("%d could not be read", failed)),
        F.format_string("%d groups covering %d photos", groups, in_groups),
        F.format_string("%d ticked for removal", marked),
        F.when(naive > 0, F.format_string("%d of %d possible comparisons evaluated", comparisons, naive)),
    )
