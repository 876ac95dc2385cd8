"""Organise plans: collision-free destinations by capture date, without touching a file.

Photos take ``folder/name`` in selection order, or ``stem (2)ext``, ``(3)``, ... while that is taken
by an earlier photo of the plan or an occupied path. So the photos of a name take its free numbers (the plain
name is number 1) in their order, and the k-th free number is arithmetic: k and as many occupied numbers as
have fewer than k free ones before them. Ranks, and the counts of occupied numbers at them, come from two levels (ranges, then
within a range), so a name that very many photos share is dealt by its ranges and never one task; no Python runs.

Names can meet only if one is another with a number (``a (2).jpg`` is number 2 of ``a.jpg``), and only if the
photos of the plain one may reach that number. Only families in which this happens are read as sorted
streams, photo by photo.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkin.functions.paths import destination_folder, extension, file_name, stem
from nearkin.runtime import cut, small

PLAN = "pos long, photo_idx long, source string, destination string, undated boolean"
#: Places or numbers of a name that one task orders.
RANGE = 8192
#: Most families or photos that may be broadcast by name.
BROADCAST_ROWS = 1_000_000
NUMBERS = r"( \(\d+\))+$"


def _split(name: str) -> tuple[str, str]:
    dot = name.rfind(".")
    return (name[:dot], name[dot:]) if dot > 0 else (name, "")


def _named(df: DataFrame, path: str) -> DataFrame:
    """With the folder's and family's key of a path."""
    name = file_name(F.col(path))
    family = F.concat(F.regexp_replace(stem(name), NUMBERS, ""), extension(name))
    return df.withColumn("family", family)


def organise_plan(photos: DataFrame, selection: DataFrame, root: str, occupied: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(pos, photo_idx, source, destination, undated, action), action being move or unchanged.

    ``photos``: (photo_idx, path, date struct or null). ``selection``: (pos, photo_idx); those
    without a photo are ignored. ``occupied``: (path). A photo's own path does not count as
    occupied for it, unless ``strict``.
    """
    chosen = selection.select("pos", "photo_idx").join(photos.select("photo_idx", F.col("path").alias("source"), "date"), "photo_idx")
    rows = chosen.select("pos", "photo_idx", "source", destination_folder(F.lit(root), F.col("date.year"), F.col("date.month")).alias("folder"), F.col("date.year").isNull().alias("undated"))
    rows = _named(rows.withColumn("name", file_name(F.col("source"))), "source")
    # cut, as it is joined with itself, and the patterns of numbers are then matched once a name and not once a photo
    names = cut(rows.groupBy("folder", "family", "name").agg(F.count(F.lit(1)).alias("n")))
    if occupied is None:
        taken = blocked = None
    else:
        # a folder is all before the last slash, as destinations are written
        taken = occupied.select("path").distinct().withColumns({"folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "name": F.regexp_extract("path", r"([^/]*)$", 1)})
        taken = taken.filter("instr(path, '/') > 0")
        plain = taken.select("folder", "name", F.lit(1).cast("long").alias("number"))
        # read by the search for meeting names, the owners and the gaps
        blocked = cut(plain.unionByName(_numbers(taken)).distinct())
    meeting = cut(_meeting(names, blocked))
    if meeting.isEmpty():
        plan = _arithmetic(rows, blocked, strict)
    else:
        meeting = small(meeting, BROADCAST_ROWS)
        others = _named(taken, "path").select("folder", "family", "path") if occupied is not None else rows.select("folder", "family", F.lit("").alias("path")).limit(0)
        plan = _arithmetic(rows.join(meeting, ["folder", "family"], "left_anti"), blocked, strict)
        plan = plan.unionByName(_streamed(rows.join(meeting, ["folder", "family"], "left_semi"), others, strict))
    return plan.withColumn("action", F.when(F.col("destination") == F.col("source"), "unchanged").otherwise("move"))


def _numbers(named: DataFrame) -> DataFrame:
    """(folder, name, number) of names that are another name with a number from 2 on."""
    at = F.regexp_extract(stem(F.col("name")), r"^(.+) \(([1-9][0-9]{0,17})\)$", 1)
    number = F.regexp_extract(stem(F.col("name")), r"^(.+) \(([1-9][0-9]{0,17})\)$", 2)
    found = named.select("folder", F.concat(at, extension(F.col("name"))).alias("base"), number.alias("number")).filter("number <> '' AND number <> '1'")
    return found.select("folder", F.col("base").alias("name"), F.expr("try_cast(number AS long)").alias("number"))


def _meeting(names: DataFrame, blocked: DataFrame | None) -> DataFrame:
    """(folder, family) of families in which photos of one name may reach a number that is another name's.

    The photos of a name take no number beyond how many they are, the numbers of it that are occupied and
    those that are names themselves.
    """
    children = _numbers(names)
    pairs = names.select("folder", "family", "name", "n").join(children, ["folder", "name"])
    if blocked is not None:
        counts = blocked.join(pairs.select("folder", "name").distinct(), ["folder", "name"], "left_semi").groupBy("folder", "name").agg(F.count(F.lit(1)).alias("occupied"))
        pairs = pairs.join(counts, ["folder", "name"], "left")
    else:
        pairs = pairs.withColumn("occupied", F.lit(0))
    reach = pairs.groupBy("folder", "family", "name", "n").agg(F.min("number").alias("first"), (F.col("n") + F.coalesce(F.max("occupied"), F.lit(0)) + F.count(F.lit(1))).alias("most"))
    return reach.filter("first <= most").select("folder", "family").distinct()


def _counted(rows: DataFrame, keys: list[str], value: str, *ties: str, of: str = "true") -> DataFrame:
    """``rows`` with ``count``: how many rows of the same keys for which ``of`` holds come up to each in the order of
    (value, ties), itself included. Rows are dealt by keys and ranges of ``value``; earlier ranges are sums."""
    dealt = rows.withColumn("range", F.expr(f"{value} div {RANGE}"))
    sums = dealt.groupBy(*keys, "range").agg(F.count_if(F.expr(of)).alias("c"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys, "range").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = dealt.withColumn("within", F.count_if(F.expr(of)).over(within))
    return ordered.join(before, [*keys, "range"]).withColumn("count", F.col("before") + F.col("within")).drop("range", "before", "within")


def _arithmetic(rows: DataFrame, blocked: DataFrame | None, strict: bool) -> DataFrame:
    """The plan of photos whose names meet no other name."""
    keys = ["folder", "name"]
    rows = rows.select("pos", "photo_idx", "source", "undated", *keys)
    if blocked is None:
        return _written(_counted(rows, keys, "pos", "photo_idx").withColumnRenamed("count", "k"))
    owners = None
    if not strict:
        # the first photo whose own path is the occupied plain name takes it
        own = rows.filter(F.col("source") == F.concat_ws("/", "folder", "name")).join(blocked.filter("number = 1"), keys, "left_semi")
        owners = cut(own.groupBy(*keys).agg(F.min(F.struct("pos", "photo_idx", "source", "undated")).alias("o")).select(*keys, "o.*"))
        rows = rows.join(small(owners.select("pos", "photo_idx"), BROADCAST_ROWS), ["pos", "photo_idx"], "left_anti")
    # an occupied number has as many free ones before it as are left when its place is taken off
    gaps = _counted(blocked, keys, "number").select(*keys, (F.col("number") - F.col("count")).alias("v"))
    ranked = _counted(rows, keys, "pos", "photo_idx").withColumn("v", F.col("count") - 1)
    both = ranked.select(*keys, "v", F.lit(1).alias("kind"), "pos", "photo_idx", "source", "undated").unionByName(gaps.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    found = _counted(cut(both), keys, "v", "kind", of="kind = 0").filter("kind = 1").withColumn("k", F.col("v") + 1 + F.col("count"))
    return _written(found if owners is None else found.drop("v", "kind", "count").unionByName(owners.withColumn("k", F.lit(1).cast("long"))))


def _written(rows: DataFrame) -> DataFrame:
    """The plan's columns from photos with their number ``k``."""
    numbered = F.concat(stem(F.col("name")), F.format_string(" (%d)", "k"), extension(F.col("name")))
    to = F.concat_ws("/", "folder", F.when(F.col("k") == 1, F.col("name")).otherwise(numbered))
    return rows.select("pos", "photo_idx", "source", to.alias("destination"), "undated")


def _streamed(rows: DataFrame, taken: DataFrame, strict: bool) -> DataFrame:
    families = rows.select("folder", "family").distinct()
    others = taken.join(families, ["folder", "family"], "left_semi").select("folder", "family", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("photo_idx"), F.col("path").alias("source"), F.lit("").alias("name"), F.lit(False).alias("undated"))
    own = rows.select("folder", "family", F.lit(1).alias("kind"), F.col("pos").cast("long"), F.col("photo_idx").cast("long"), "source", "name", "undated")
    # by an expression: the planner takes a union's own columns for dealt already and drops the exchange
    stream = own.unionByName(others).repartition(F.xxhash64("folder", "family")).sortWithinPartitions("folder", "family", "kind", "pos", "photo_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, claimed, occupied, tried = None, set(), set(), {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.folder, r.family) != now:
                    now, claimed, occupied, tried = (r.folder, r.family), set(), set(), {}
                if r.kind == 0:
                    occupied.add(r.source)
                    continue
                head, tail = _split(r.name)
                # numbers below the last one given out are taken, but for a photo's own path
                k = 1 if r.source in occupied else tried.get(r.name, 1)
                while True:
                    to = f"{r.folder}/{r.name}" if k == 1 else f"{r.folder}/{head} ({k}){tail}"
                    if to not in claimed and (to not in occupied or to == r.source and not strict):
                        break
                    k += 1
                claimed.add(to)
                tried[r.name] = max(k, tried.get(r.name, 1))
                out.append((r.pos, r.photo_idx, r.source, to, r.undated))
            yield pd.DataFrame(out, columns=["pos", "photo_idx", "source", "destination", "undated"])

    return stream.mapInPandas(run, PLAN)


def organise_counts(plan: DataFrame) -> DataFrame:
    """(moves, undated, unchanged): undated counts unchanged photos too."""
    return plan.agg(F.count_if(F.col("action") == "move").alias("moves"), F.count_if("undated").alias("undated"), F.count_if(F.col("action") == "unchanged").alias("unchanged"))


def rewrite_paths(photos: DataFrame, moved: DataFrame) -> DataFrame:
    """``photos`` with the paths of successful moves; of photos with equal paths the first one moves.

    ``moved``: (source, destination, ok).
    """
    first = photos.groupBy("path").agg(F.min("photo_idx").alias("photo_idx"))
    done = moved.filter("ok").groupBy("source").agg(F.min("destination").alias("destination"))
    new = first.join(done, first["path"] == done["source"]).select(F.col("photo_idx").alias("_moved"), "destination")
    out = photos.join(new, photos["photo_idx"] == new["_moved"], "left")
    return out.withColumn("path", F.coalesce("destination", "path")).drop("_moved", "destination")


def selection_of(photos: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(pos, photo_idx): decoded photos that are not marked for removal, in their order."""
    rows = photos.filter("decoded").select("photo_idx")
    if marked is not None:
        rows = rows.join(marked.select("photo_idx"), "photo_idx", "left_anti")
    return rows.select(F.col("photo_idx").alias("pos"), "photo_idx")
