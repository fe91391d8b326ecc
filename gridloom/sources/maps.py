"""Density map files (float32 grids behind a 1024-byte header): a partitioned source, and writers."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.operators.grid import Grid, reorder_axes

HEADER = 1024
#: Values that one task reads.
SLAB_VALUES = 4_000_000


@dataclass(frozen=True)
class MapHeader:
    """Sizes along the stored axes, which of x, y, z they are, spacing and origin by x, y, z, and where the values start."""

    stored: tuple[int, int, int]
    order: tuple[int, int, int]
    spacing: tuple[float, float, float]
    origin: tuple[float, float, float]
    start: int
    swapped: bool

    @property
    def grid(self) -> Grid:
        by_axis = dict(zip(self.order, self.stored))
        return Grid((by_axis[1], by_axis[2], by_axis[3]), self.spacing, self.origin)


def read_header(path: str) -> MapHeader:
    """Header of a map. ``.ccp4`` and ``.map`` files have their origin as start indices x spacing, ``.mrc`` files as a position."""
    path = path.removeprefix("file://")
    with open(path, "rb") as f:
        raw = f.read(HEADER)
    if len(raw) < HEADER:
        raise ValueError(f"{path}: shorter than its header")
    order = "<" if 0 < struct.unpack("<i", raw[12:16])[0] < 256 or raw[12:16] == b"\0\0\0\0" else ">"
    words = struct.unpack(f"{order}10i6f3i3f2i25i3f", raw[:208])
    stored, mode, starts, cells, lengths, axes, extra, origin = words[0:3], words[3], words[4:7], words[7:10], words[10:13], words[16:19], words[23], words[49:52]
    if mode != 2:
        raise ValueError(f"{path}: only 32-bit float maps (mode 2) are read")
    if sorted(axes) != [1, 2, 3] or min(stored) < 1 or min(cells) < 1:
        raise ValueError(f"{path}: invalid sizes or axis order")
    spacing = tuple(length / n for length, n in zip(lengths, cells))
    if not path.lower().endswith(".mrc"):
        by_axis = dict(zip(axes, starts))
        origin = tuple(by_axis[a] * s for a, s in zip((1, 2, 3), spacing))
    return MapHeader(stored, axes, spacing, tuple(origin), HEADER + max(0, extra), order == ">")


class _Slab(InputPartition):
    def __init__(self, first: int, count: int) -> None:
        self.first, self.count = first, count


class _MapReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.header = path.removeprefix("file://"), read_header(path)

    def partitions(self) -> list[_Slab]:
        nx, ny, nz = self.header.stored
        layers = max(1, SLAB_VALUES // (nx * ny))
        return [_Slab(z * nx * ny, min(layers, nz - z) * nx * ny) for z in range(0, nz, layers)]

    def read(self, slab: _Slab) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(self.header.start + 4 * slab.first)
            raw = f.read(4 * slab.count)
        if len(raw) < 4 * slab.count:
            raise ValueError(f"{self.path}: values are missing")
        v = np.frombuffer(raw, ">f4" if self.header.swapped else "<f4").astype(np.float32)
        step = 1 << 20
        for at in range(0, len(v), step):
            part = v[at : at + step]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(slab.first + at, slab.first + at + len(part), dtype=np.int64)), pa.array(part)], names=["gid", "value"]
            )


class MapSource(DataSource):
    """spark.read.format("density_map").load(path): gid in stored order, value; a partition is a slab of layers."""

    @classmethod
    def name(cls) -> str:
        return "density_map"

    def schema(self) -> str:
        return "gid long, value float"

    def reader(self, schema) -> _MapReader:
        return _MapReader(self.options["path"])


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Voxels with canonical linear index (x fastest), and their grid."""
    spark.dataSource.register(MapSource)
    h = read_header(path)
    v = spark.read.format("density_map").load(path)
    if h.order != (1, 2, 3):
        v = reorder_axes(v, "gid", h.stored, h.order)
    return v, h.grid


def write_map(voxel: DataFrame, grid: Grid, path: str, value: str = "value") -> None:
    """One map file in a folder that all workers share, made if it is missing. The driver writes the header (exact extremes,
    mean and deviation) and sets the length; each task fills slabs of at most SLAB_VALUES values at their place in the file, so
    that a repeated task writes the same bytes. Missing voxels are 0; of repeated ones the least value counts."""
    s = voxel.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("m"), F.stddev_pop(value).alias("sd")).first()
    mrc = path.lower().endswith(".mrc")
    starts = (0, 0, 0) if mrc else tuple(round(o / s_) for o, s_ in zip(grid.origin, grid.spacing))
    words = [
        *grid.size, 2, *starts, *grid.size, *[n * d for n, d in zip(grid.size, grid.spacing)], 90.0, 90.0, 90.0, 1, 2, 3, s["lo"] or 0.0,
        s["hi"] or 0.0, s["m"] or 0.0, 1, 0, *[0] * 25, *(grid.origin if mrc else (0.0, 0.0, 0.0))
    ]
    head = struct.pack("<10i6f3i3f2i25i3f", *words) + b"MAP " + bytes([0x44, 0x44, 0, 0]) + struct.pack("<fi", s["sd"] or 0.0, 0)
    place, slab, total = path.removeprefix("file://"), SLAB_VALUES, grid.n
    Path(place).parent.mkdir(parents=True, exist_ok=True)
    with open(place, "wb") as f:
        f.write(head.ljust(HEADER, b"\0"))
        f.truncate(HEADER + 4 * grid.n)
    v = voxel.select(
        F.col("gid").cast("long").alias("gid"), F.col(value).cast("float").alias("v")
    ).where(F.col("gid").between(0, grid.n - 1) & F.col("v").isNotNull())
    v = v.groupBy("gid").agg(F.min("v").alias("v"))

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        first = key[0].as_py() * slab
        values = np.zeros(min(slab, total - first), "<f4")
        values[rows["gid"].to_numpy() - first] = rows["v"].to_numpy()
        with open(place, "r+b") as out:
            out.seek(HEADER + 4 * first)
            out.write(values.tobytes())
        return pa.table({"n": pa.array([rows.num_rows], pa.int64())})

    v.groupBy(F.floor(F.col("gid") / slab).alias("slab")).applyInArrow(fill, "n long").agg(F.sum("n")).collect()
