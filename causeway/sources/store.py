"""A chunk store as a Spark data source: rows of a Parquet table beside the vectors of a flat index file.

``register(spark)``, then ``spark.read.format("causeway_store").load(path)`` and ``df.write.format("causeway_store")``.
A store is a folder of one of these kinds, sought in this order (A6):

* a manifest and the folders it names, as the writer here makes them, each with numbered shards of the second kind;
* ``index.faiss`` and ``vector_df.parquet`` (A3, D3);
* ``faiss_index.idx``, ``chunks.parquet`` (text) and ``sources.parquet`` (source) (A5).

Pickled stores are refused, since reading one runs what is in it. Files of different lengths are an error, row by row they
belong together. Columns are those of the Parquet files and ``vector``, an array of floats. A row group is a partition, and
the vectors of one are read by their place, a batch at a time; groups that no row of can meet the filters are not read at all.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.pandas.types import from_arrow_schema

# fixed values: file names, and the head of a flat index file (mark, width, rows, two spare numbers, trained, metric, numbers)
MANIFEST = "_shards.json"
PAIR = ("index.faiss", "vector_df.parquet")
TRIPLE = ("faiss_index.idx", "chunks.parquet", "sources.parquet")
PICKLES = ("index.pkl", "chunks.pkl", "sources.pkl")
HEAD = np.dtype([("mark", "S4"), ("width", "<i4"), ("rows", "<i8"), ("spare", "<i8", 2), ("trained", "u1"), ("metric", "<i4"), ("numbers", "<u8")])
MARKS = (b"IxFI", b"IxF2")
#: rows of a shard, all that a writing task holds, and of a row group and a batch, all that a reading task holds
SHARD_ROWS, GROUP_ROWS = 16384, 4096


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path there; file: addresses and plain paths are the machine's (or a mounted shared) folders."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _there(files: fs.FileSystem, folder: str, names: tuple[str, ...]) -> list[bool]:
    return [f.type == fs.FileType.File for f in files.get_file_info([posixpath.join(folder, n) for n in names])]


def head_of(files: fs.FileSystem, path: str) -> tuple[int, int]:
    """Width and rows of a flat index file; any other file is an error."""
    with files.open_input_file(path) as f:
        raw = f.read(HEAD.itemsize)
        size = f.size()
    if len(raw) < HEAD.itemsize:
        raise ValueError(f"{path} is no flat index")
    head = np.frombuffer(raw, HEAD)[0]
    width, rows = int(head["width"]), int(head["rows"])
    if head["mark"] not in MARKS or int(head["numbers"]) != width * rows or size != HEAD.itemsize + 4 * width * rows:
        raise ValueError(f"{path} is no flat index, or not whole")
    return width, rows


def stores_in(files: fs.FileSystem, folder: str) -> list[tuple[str, tuple[str, ...]]]:
    """The folders that hold vectors and rows side by side, and the names there."""
    if _there(files, folder, (MANIFEST,))[0]:
        with files.open_input_file(posixpath.join(folder, MANIFEST)) as f:
            return [(posixpath.join(folder, name, str(i)), PAIR) for name, shards in json.loads(f.read()) for i in range(shards)]
    for names in (PAIR, TRIPLE):
        if all(_there(files, folder, names)):
            return [(folder, names)]
    if any(_there(files, folder, PICKLES)):
        raise ValueError(f"{folder} is a pickled store, which is unsafe to read; expected {MANIFEST}, {PAIR} or {TRIPLE}")
    raise FileNotFoundError(f"no store in {folder}: expected {MANIFEST}, {PAIR} or {TRIPLE}")


def possible(low, high, nulls: bool, known: bool, test: S.Filter) -> bool:
    """Can a row of a group whose column lies between ``low`` and ``high`` pass ``test``? True where nothing is known."""
    if isinstance(test, S.IsNotNull):
        return not known or low is not None
    if isinstance(test, S.IsNull):
        return nulls
    if not known:
        return True
    if low is None:  # nulls alone pass no comparison
        return False
    values = test.value if isinstance(test, S.In) else (test.value,)
    checks = {S.EqualTo: lambda x: low <= x <= high, S.In: lambda x: low <= x <= high, S.GreaterThan: lambda x: high > x, S.GreaterThanOrEqual: lambda x: high >= x, S.LessThan: lambda x: low < x, S.LessThanOrEqual: lambda x: low <= x}
    try:
        return any(checks[type(test)](x) for x in values if x is not None)
    except TypeError:  # values of another kind than the statistics'
        return True


TESTS = (S.EqualTo, S.In, S.GreaterThan, S.GreaterThanOrEqual, S.LessThan, S.LessThanOrEqual, S.IsNotNull, S.IsNull)


def _passes(group: pq.RowGroupMetaData, tests: list[S.Filter]) -> bool:
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    for test in tests:
        column = columns.get(test.attribute[0])
        stats = column.statistics if column is not None else None
        if stats is None or not stats.has_null_count:
            continue
        known = stats.has_min_max or stats.null_count == group.num_rows
        if not possible(stats.min if stats.has_min_max else None, stats.max if stats.has_min_max else None, stats.null_count > 0, known, test):
            return False
    return True


@dataclass
class Rows(S.InputPartition):
    """Rows ``begin`` to ``end`` of one store; of a pair, they are row group ``group``."""

    folder: str
    names: tuple[str, ...]
    group: int
    begin: int
    end: int
    width: int


class StoreReader(S.DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        """Filters choose row groups; Spark applies them all again to the rows."""
        self.tests = [f for f in filters if isinstance(f, TESTS) and len(f.attribute) == 1 and f.attribute[0] != "vector"]
        return filters

    def partitions(self):
        files, root = _open(self.path)
        found = []
        for folder, names in stores_in(files, root):
            width, rows = head_of(files, posixpath.join(folder, names[0]))
            tables = [pq.ParquetFile(posixpath.join(folder, n), filesystem=files).metadata for n in names[1:]]
            if any(t.num_rows != rows for t in tables):
                raise ValueError(f"{folder}: {rows} vectors, but {', '.join(f'{t.num_rows} rows in {n}' for t, n in zip(tables, names[1:]))}")
            begin = 0
            for g in range(tables[0].num_row_groups):
                group = tables[0].row_group(g)
                if _passes(group, self.tests):
                    found.append(Rows(folder, names, g, begin, begin + group.num_rows, width))
                begin += group.num_rows
        return found or [Rows("", (), 0, 0, 0, 0)]

    def read(self, partition):
        if not partition.names:
            return
        files, _ = _open(self.path)
        at = lambda name: posixpath.join(partition.folder, name)
        sides = [self._rows(files, at(name), partition.begin, partition.end) for name in partition.names[2:]]
        begin = partition.begin
        with files.open_input_file(at(partition.names[0])) as f:
            for batch in pq.ParquetFile(at(partition.names[1]), filesystem=files).iter_batches(GROUP_ROWS, row_groups=[partition.group]):
                end = begin + batch.num_rows
                table = pa.Table.from_batches([batch])
                for side in sides:
                    more = side.slice(begin - partition.begin, batch.num_rows)
                    for column in more.column_names:
                        table = table.append_column(column, more[column])
                f.seek(HEAD.itemsize + 4 * partition.width * begin)
                numbers = np.frombuffer(f.read(4 * partition.width * (end - begin)), "<f4")
                offsets = pa.array(np.arange(end - begin + 1, dtype=np.int32) * np.int32(partition.width))
                yield from table.append_column("vector", pa.ListArray.from_arrays(offsets, pa.array(numbers))).combine_chunks().to_batches()
                begin = end

    def _rows(self, files: fs.FileSystem, path: str, begin: int, end: int) -> pa.Table:
        """Rows ``begin`` to ``end`` of a table whose row groups are its own."""
        table = pq.ParquetFile(path, filesystem=files)
        seen, parts, first = 0, [], 0
        for g in range(table.metadata.num_row_groups):
            n = table.metadata.row_group(g).num_rows
            if seen < end and seen + n > begin:
                first = first if parts else seen
                parts.append(table.read_row_group(g))
            seen += n
        return pa.concat_tables(parts).slice(begin - first, end - begin)


@dataclass
class Written(S.WriterCommitMessage):
    folder: str
    shards: int


class StoreWriter(S.DataSourceArrowWriter):
    """Every task writes shards into a folder of its own name; the manifest, written last, names those of tasks that ended well."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        files, root = _open(self.path)
        name, held, rows, shards = f"rows-{uuid.uuid4().hex}", [], 0, 0
        for batch in iterator:
            for start in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(start, GROUP_ROWS)
                if rows and rows + part.num_rows > SHARD_ROWS:
                    self.shard(files, posixpath.join(root, name, str(shards)), pa.Table.from_batches(held))
                    held, rows, shards = [], 0, shards + 1
                held.append(part)
                rows += part.num_rows
        if rows:
            self.shard(files, posixpath.join(root, name, str(shards)), pa.Table.from_batches(held))
            shards += 1
        return Written(name, shards)

    def shard(self, files: fs.FileSystem, folder: str, table: pa.Table) -> None:
        vectors = table["vector"].combine_chunks()
        widths = set(vectors.value_lengths().to_pylist())
        if len(widths) != 1 or None in widths or vectors.flatten().null_count:
            raise ValueError("a store's vectors have one length and no nulls")
        numbers = np.asarray(vectors.flatten(), dtype="<f4")
        head = np.array([(MARKS[0], widths.pop(), len(table), (1 << 20, 1 << 20), 1, 0, len(numbers))], HEAD)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(posixpath.join(folder, PAIR[0])) as f:
            f.write(head.tobytes())
            f.write(numbers.tobytes())
        pq.write_table(table.drop_columns("vector"), posixpath.join(folder, PAIR[1]), filesystem=files, row_group_size=GROUP_ROWS)

    def commit(self, messages):
        files, root = _open(self.path)
        listed = [(m.folder, m.shards) for m in messages if m is not None and m.shards]
        if not self.overwrite and _there(files, root, (MANIFEST,))[0]:
            with files.open_input_file(posixpath.join(root, MANIFEST)) as f:
                listed = json.loads(f.read()) + listed
        files.create_dir(root, recursive=True)
        with files.open_output_stream(posixpath.join(root, MANIFEST)) as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages):
        """Nothing to undo: folders that no manifest names are never read."""


class ChunkStore(S.DataSource):
    @classmethod
    def name(cls):
        return "causeway_store"

    def schema(self):
        files, root = _open(self.options["path"])
        found = stores_in(files, root)
        if not found:
            raise ValueError(f"{root} holds no rows, so its columns must be given: spark.read.schema(...)")
        folder, names = found[0]
        tables = [pq.ParquetFile(posixpath.join(folder, n), filesystem=files).schema_arrow for n in names[1:]]
        return from_arrow_schema(pa.schema([*(f for t in tables for f in t.remove_metadata()), pa.field("vector", pa.list_(pa.float32()))]))

    def reader(self, schema):
        return StoreReader(self.options["path"])

    def writer(self, schema, overwrite):
        return StoreWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``causeway_store`` known to the session, with filters passed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(ChunkStore)
