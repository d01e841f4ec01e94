"""Data sources for array files: NumPy archives split by rows, and binary sorter files (level 5) by variable.

The driver reads directories and array headers only; tasks read the bytes. Both
are ordinary Spark sources: ``spark.read.format(...)`` after ``register``.
Paths are those that ``pyarrow.fs`` opens (local, hdfs, s3, gs), a file or a folder.
"""

from __future__ import annotations

import math
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import broadcast_if_small
from .sorted_units import FIELD_NAMES, RAW_FIELD_NAMES, load_units

SNIPPET_ROWS = "file string, snippet_id long, w array<double>, class_label int, unit_id int"
VARIABLE_ROWS = "file string, variable string, row long, values array<double>"


def _files(path: str, ending: str) -> list[str]:
    """Files under ``path`` in order of name, as paths of its file system."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    system, place = FileSystem.from_uri(path)
    info = system.get_file_info(place)
    if info.type == FileType.File:
        return [place]
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(f.path for f in system.get_file_info(FileSelector(place, recursive=True)) if f.type == FileType.File and f.path.lower().endswith(ending))


def _open(path: str, place: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)[0].open_input_file(place)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


# --- NumPy archives ---------------------------------------------------------------------------------


@dataclass
class Member(InputPartition):
    """An array of an archive: its type, shape, and where its bytes start if they are stored as they are."""

    name: str
    kind: str
    shape: tuple[int, ...]
    start: int | None
    fortran: bool

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.kind).itemsize * math.prod(self.shape[1:])


@dataclass
class RowRange(InputPartition):
    place: str
    members: dict[str, Member]
    first: int
    last: int


def _array_header(data) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, column order and type of an array whose content follows."""
    version = np.lib.format.read_magic(data)
    if version == (1, 0):
        return np.lib.format.read_array_header_1_0(data)
    if version == (2, 0):
        return np.lib.format.read_array_header_2_0(data)
    raise ValueError(f"array format {version} is not covered")


def members(path: str, place: str) -> dict[str, Member]:
    """Arrays of an archive by name, from the directory and the arrays' headers."""
    out = {}
    with _open(path, place) as raw, zipfile.ZipFile(raw) as archive:
        for info in archive.infolist():
            if not info.filename.endswith(".npy"):
                continue
            with archive.open(info) as data:
                shape, fortran, kind = _array_header(data)
                if kind.hasobject:
                    continue
                head = data.tell()
            start = None
            if info.compress_type == zipfile.ZIP_STORED:
                raw.seek(info.header_offset)
                local = raw.read(30)
                name, extra = struct.unpack("<HH", local[26:30])
                start = info.header_offset + 30 + name + extra + head
            out[info.filename.removesuffix(".npy")] = Member(info.filename, kind.str, shape, start, fortran)
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rowsPerTask", 250_000))
        self.batch = int(options.get("rowsPerBatch", 10_000))

    def partitions(self) -> list[RowRange]:
        out = []
        for place in _files(self.path, ".npz"):
            held = members(self.path, place)
            if "waveforms" not in held or len(held["waveforms"].shape) != 2:
                raise ValueError(f"{place} has no two-dimensional array 'waveforms'; it has {sorted(held)}")
            used = {n: held[n] for n in ("waveforms", "class_labels", "unit_ids") if n in held}
            n = used["waveforms"].shape[0]
            whole = any(m.start is None or m.fortran for m in used.values())  # deflated bytes can only be read from their start
            step = max(n, 1) if whole else self.rows
            out += [RowRange(place, used, a, min(n, a + step)) for a in range(0, n, step)]
        return out

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        with _open(self.path, part.place) as raw, zipfile.ZipFile(raw) as archive:
            streams = {}
            for n, m in part.members.items():
                if m.start is None:
                    streams[n] = archive.open(m.name)
                    _array_header(streams[n])
            fortran = {n: np.frombuffer(streams[n].read() if n in streams else raw.read_at(m.row_bytes * m.shape[0], m.start), m.kind).reshape(m.shape, order="F") for n, m in part.members.items() if m.fortran and len(m.shape) > 1}
            for a in range(part.first, part.last, self.batch):
                b = min(part.last, a + self.batch)
                got = {}
                for n, m in part.members.items():
                    if n in fortran:
                        got[n] = fortran[n][a:b]
                        continue
                    size = (b - a) * m.row_bytes
                    data = streams[n].read(size) if n in streams else raw.read_at(size, m.start + a * m.row_bytes)
                    got[n] = np.frombuffer(data, m.kind).reshape(b - a, *m.shape[1:])
                label = got["class_labels"] if "class_labels" in got else np.ones(b - a)
                unit = got["unit_ids"] if "unit_ids" in got else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.place] * (b - a), pa.string()), pa.array(np.arange(a, b, dtype=np.int64)), _lists(got["waveforms"]), pa.array(label.astype(np.int32)), pa.array(unit.astype(np.int32))],
                    names=["file", "snippet_id", "w", "class_label", "unit_id"],
                )


class SnippetArchives(DataSource):
    """``spark.read.format("snippet_archives").load(path)``: rows of the arrays waveforms, class_labels and unit_ids.

    Missing labels are class 1 and unit 0. Stored arrays are split into ranges of
    ``rowsPerTask`` rows, each read at its own place in the file; deflated ones
    are read from their start by one task, ``rowsPerBatch`` rows at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "snippet_archives"

    def schema(self) -> str:
        return SNIPPET_ROWS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


# --- binary sorter files -----------------------------------------------------------------------------

# Fixed values of the format: numeric element types, and array classes that hold numbers.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED = 14, 15
_NUMERIC_CLASSES = range(6, 16)
_HDF_MAGIC = b"\x89HDF"


@dataclass
class Variable(InputPartition):
    """A numeric matrix of a file: where its element lies and how its numbers are read."""

    place: str
    name: str
    shape: tuple[int, ...]
    offset: int
    size: int
    compressed: bool
    order: str


def byte_order(header: bytes) -> str:
    """Order of the file's numbers from its 128 header bytes; other formats raise an error that names them."""
    if header[:4] == _HDF_MAGIC:
        raise ValueError("an HDF5 file (level 7.3); export it as level 7 or lower, or as a table")
    if len(header) < 128 or header[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level 5 file")
    return "<" if header[126:128] == b"IM" else ">"


def _tag(data: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """(type, bytes, start of the bytes, start of the next element)."""
    kind, size = struct.unpack_from(f"{order}II", data, at)
    if kind >> 16:  # small element: both in one word, the bytes in the next
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + -(-size // 8) * 8


def _matrix_head(data: bytes, order: str) -> tuple[str, tuple[int, ...], int, int, str | None]:
    """(name, shape, class, start of the numbers, their type) of a matrix element's content; type None if it is not told within ``data``."""
    _, _, flags, at = _tag(data, 0, order)
    kind = struct.unpack_from(f"{order}I", data, flags)[0]
    _, size, dims, after = _tag(data, at, order)
    shape = struct.unpack_from(f"{order}{size // 4}i", data, dims)
    _, size, start, at = _tag(data, after, order)
    name = data[start : start + size].decode("latin-1")
    cls, complex_ = kind & 0xFF, bool(kind & 0x800)
    if cls not in _NUMERIC_CLASSES or complex_ or len(data) < at + 8:
        return name, shape, 0, 0, None
    number, _, start, _ = _tag(data, at, order)
    return name, shape, cls, start, _NUMBERS.get(number)


def variables(path: str, place: str) -> list[Variable]:
    """Numeric matrices of a file, by tags and the first bytes of each element."""
    out = []
    with _open(path, place) as f:
        length = f.size()
        order = byte_order(f.read_at(min(128, length), 0))
        at = 128
        while at + 8 <= length:
            kind, size = struct.unpack(f"{order}II", f.read_at(8, at))
            head = f.read_at(min(size, 65_536), at + 8)
            if kind == _COMPRESSED:
                head = zlib.decompressobj().decompress(head, 65_536)
                inner, head = struct.unpack_from(f"{order}I", head)[0], head[8:]
            else:
                inner = kind
            if inner == _MATRIX and size:
                name, shape, _, _, number = _matrix_head(head, order)
                if number is not None and math.prod(shape):
                    out.append(Variable(place, name, tuple(shape), at + 8, size, kind == _COMPRESSED, order))
            at += 8 + (size if kind == _COMPRESSED else -(-size // 8) * 8)
    return out


class SorterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.wanted = {n for n in options.get("variables", "").split(",") if n}
        self.batch = int(options.get("rowsPerBatch", 10_000))

    def partitions(self) -> list[Variable]:
        return [v for place in _files(self.path, ".mat") for v in variables(self.path, place) if not self.wanted or v.name in self.wanted]

    def read(self, part: Variable) -> Iterator[pa.RecordBatch]:
        with _open(self.path, part.place) as f:
            data = f.read_at(part.size, part.offset)
        if part.compressed:
            data = zlib.decompress(data)[8:]
        _, shape, _, start, number = _matrix_head(data, part.order)
        flat = np.frombuffer(data, np.dtype(number).newbyteorder(part.order), math.prod(shape), start)
        rows = flat.reshape(-1, 1) if 1 in shape and len(shape) == 2 else flat.reshape(shape, order="F").reshape(shape[0], -1, order="F")
        for a in range(0, len(rows), self.batch):
            own = rows[a : a + self.batch]
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([part.place] * n, pa.string()), pa.array([part.name] * n, pa.string()), pa.array(np.arange(a, a + n, dtype=np.int64)), _lists(own)], names=["file", "variable", "row", "values"])


class SorterFiles(DataSource):
    """``spark.read.format("sorter_files").load(path)``: rows of the numeric matrices of level 5 files.

    One task per file and variable (all, or those of the option ``variables``);
    vectors give a row per number. Text, cells and structures are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "sorter_files"

    def schema(self) -> str:
        return VARIABLE_ROWS

    def reader(self, schema) -> DataSourceReader:
        return SorterReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnippetArchives)
    spark.dataSource.register(SorterFiles)


def read_npz(spark: SparkSession, path: str, *, rows_per_task: int = 250_000) -> DataFrame:
    """Snippets (file, snippet_id, w, class_label, unit_id) of NumPy archives, split by rows where the arrays are stored."""
    register(spark)
    return spark.read.format("snippet_archives").option("rowsPerTask", rows_per_task).load(path)


def read_sorter_files(spark: SparkSession, path: str, *, raw: bool = False, lowest: int = 1, highest: int = 999) -> DataFrame:
    """Units and noise of level 5 files, canonical as ``load_units`` gives them.

    Each file's variables are found by their names; times, waveforms, unit ids and
    noise snippets meet by their row.
    """
    register(spark)
    names = FIELD_NAMES | (RAW_FIELD_NAMES if raw else {})
    listed: dict[str, set[str]] = {}
    for place in _files(path, ".mat"):
        for v in variables(path, place):
            listed.setdefault(place, set()).add(v.name)
    chosen, table = {}, []
    for place, own in listed.items():
        lower = {n.lower(): n for n in sorted(own)}
        for role, options in names.items():
            hit = next((o for o in options if o in own), None) or next((lower[o.lower()] for o in options if o.lower() in lower), None)
            if hit:
                table.append((place, hit, role))
                chosen[role] = options[0]
    missing = [r for r in ("spike_times", "waveforms") if r not in chosen]
    if missing:
        raise ValueError(f"no variable for {missing}; the files have {sorted(set().union(*listed.values()))[:30] if listed else []}")
    roles = spark.createDataFrame(table, "file string, variable string, role string")  # files x variables
    rows = spark.read.format("sorter_files").option("variables", ",".join(sorted({v for _, v, _ in table}))).load(path)
    found = rows.join(broadcast_if_small(roles, 500_000), ["file", "variable"]).groupBy("file", F.col("row").alias("spike_index"))
    columns = [F.max(F.when(F.col("role") == r, F.col("values"))).alias(n) for r, n in chosen.items()]  # one row of each variable
    wide = found.agg(*columns)
    single = {n: F.col(n)[0] for r, n in chosen.items() if r in ("spike_times", "unit_ids")}
    return load_units(wide.withColumns(single), lowest=lowest, highest=highest, raw=raw)
