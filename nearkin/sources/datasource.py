"""A data source of photos with a decoder of one's own: ``spark.read.format("photos")``.

Options: ``path``, a folder (URI or local path) that the tasks can read; ``decoder``, as ``package.module:function``, takes
(path, bytes) and gives (gray 2-D array, original width, original height) or None; ``packed``, where the photos are rows
(path, content) of Parquet files instead of files of their own; ``tags``, which gives capture times alone and reads no more than the
first 128 KiB of a file; ``partitionbytes``, how much one task reads.

Each file, or row group, is read once, by one task, and what is decoded and the capture time come from the same bytes.
Nothing but names and sizes is listed beforehand. A file that cannot be read or decoded has decoded=false.
Files are read by ``pyarrow.fs``, so any store that it opens will do.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from nearkin.functions.exif import DATE_TYPE, PARTS, PREFIX_BYTES, read_date
from nearkin.functions.paths import PHOTO_EXTENSIONS
from nearkin.functions.raster import np_difference_hash, np_laplacian_variance
from nearkin.sources.images import FEATURES

TAGS = f"path string, file_size long, bytes_read long, date {DATE_TYPE}"
PARTITION_BYTES = 64 << 20
#: Photos of one batch.
BATCH = 256
DATE = pa.struct([(k, pa.int32()) for k in PARTS])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path) if path.startswith("/") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """(name, size) of files."""

    files: list[tuple[str, int]]


@dataclass
class RowGroups(InputPartition):
    """(name, row group) of packed photos."""

    groups: list[tuple[str, int]]


def _dealt(items: list[tuple], sizes: list[int], most: int) -> list[list[tuple]]:
    """Runs of items of about ``most`` bytes; an item is never cut."""
    out, held = [], 0
    for item, size in zip(items, sizes, strict=True):
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(item)
        held += size
    return out


class PhotoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        self.path, self.decoder = options["path"], options.get("decoder")
        self.packed, self.tags = flag("packed"), flag("tags")
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        if not self.tags and not self.decoder:
            raise ValueError("the option decoder names a function, as package.module:function")

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        endings = ("parquet",) if self.packed else PHOTO_EXTENSIONS
        found = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.lower().rpartition(".")[2] in endings]
        found.sort(key=lambda i: i.path)
        if not self.packed:
            most = [min(i.size, PREFIX_BYTES) if self.tags else i.size for i in found]
            return [Files(x) for x in _dealt([(i.path, i.size) for i in found], most, self.most)]
        groups, sizes = [], []
        for info in found:
            with store.open_input_file(info.path) as f:
                meta = pq.ParquetFile(f).metadata
            groups += [(info.path, k) for k in range(meta.num_row_groups)]
            sizes += [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
        return [RowGroups(x) for x in _dealt(groups, sizes, self.most)]

    def _contents(self, partition: InputPartition) -> Iterator[tuple[str, int, bytes | None]]:
        """(path, size, bytes) of each photo; only a prefix for capture times."""
        store, _ = opened(self.path)
        if isinstance(partition, RowGroups):
            for name, group in partition.groups:
                with store.open_input_file(name) as f:
                    for batch in pq.ParquetFile(f).iter_batches(BATCH, row_groups=[group], columns=["path", "content"]):
                        for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                            yield path, len(data or b""), data if data is None or not self.tags else data[:PREFIX_BYTES]
            return
        for name, size in partition.files:
            try:
                with store.open_input_file(name) as f:
                    yield name, size, f.read_at(min(size, PREFIX_BYTES) if self.tags else size, 0)
            except OSError:
                yield name, size, None

    def _row(self, decode, path: str, size: int, data: bytes | None) -> tuple:
        date = None if data is None else read_date(data[:PREFIX_BYTES])
        shown = date and dict(zip(PARTS, date, strict=True))
        if self.tags:
            return path, size, len(data or b""), shown
        found = None if data is None else decode(path, data)
        if found is None:
            return path, size, 0, 0.0, None, 0, 0, False
        gray, width, height = found
        return path, size, np_difference_hash(gray), np_laplacian_variance(gray), shown, width, height, True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), DATE] if self.tags else [pa.string(), pa.int64(), pa.int64(), pa.float64(), DATE, pa.int32(), pa.int32(), pa.bool_()]
        names = [x.split()[0] for x in (TAGS if self.tags else FEATURES).split(", ")]
        decode = None
        if not self.tags:
            module, _, function = self.decoder.partition(":")
            decode = getattr(importlib.import_module(module), function)
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for found in self._contents(partition):
            held.append(self._row(decode, *found))
            if len(held) == BATCH:
                yield out()
                held.clear()
        if held:
            yield out()


class PhotoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "photos"

    def schema(self) -> str:
        return TAGS if str(self.options.get("tags", "false")).lower() == "true" else FEATURES

    def reader(self, schema) -> PhotoReader:
        return PhotoReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session."""
    spark.dataSource.register(PhotoSource)
    return spark
