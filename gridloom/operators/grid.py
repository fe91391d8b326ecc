"""Regular grids: index arithmetic, interpolation, scatter-add. A voxel table has gid, value and the grid's keys."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Grid:
    """Sizes, spacings and origin of a grid whose linear index runs fastest along x."""

    size: tuple[int, int, int]
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def n(self) -> int:
        return self.size[0] * self.size[1] * self.size[2]

    def index(self, gid: Column) -> tuple[Column, Column, Column]:
        nx, ny, _ = self.size
        g = gid.cast("long")
        plane = F.lit(nx * ny)
        down = lambda a, b: F.floor(a / b).cast("long")
        z = down(g, plane)
        rest = g - z * plane
        y = down(rest, F.lit(nx))
        return rest - y * nx, y, z

    def gid(self, ix: Column, iy: Column, iz: Column) -> Column:
        nx, ny, _ = self.size
        return ix.cast("long") + nx * (iy.cast("long") + ny * iz.cast("long"))

    def position(self, gid: Column) -> tuple[Column, ...]:
        return tuple(i * s + o for i, s, o in zip(self.index(gid), self.spacing, self.origin))

    def contains(self, *p: Column) -> Column:
        """Within half a voxel of the grid."""
        ok = F.lit(True)
        for c, n, s, o in zip(p, self.size, self.spacing, self.origin):
            ok = ok & (c >= o - 0.5 * s) & (c <= o + (n - 0.5) * s)
        return ok

    def floor_index(self, *p: Column) -> tuple[Column, ...]:
        """Voxel below a position; -1 on every axis for positions outside."""
        inside = self.contains(*p)
        return tuple(F.when(inside, F.floor((c - o) / s)).otherwise(-1).cast("long") for c, s, o in zip(p, self.spacing, self.origin))

    @staticmethod
    def around(low: Sequence[float], high: Sequence[float], spacing: float, margin: float) -> Grid:
        """The grid that a set of points with this range needs, widened by ``margin``."""
        lo, hi = [v - margin for v in low], [v + margin for v in high]
        origin = tuple(math.floor(v / spacing) * spacing for v in lo)
        return Grid(tuple(math.ceil((h - v) / spacing) for v, h in zip(lo, hi)), (spacing,) * 3, origin)


def voxels(spark: SparkSession, grid: Grid) -> DataFrame:
    return spark.range(grid.n).withColumnRenamed("id", "gid")


def reorder_axes(df: DataFrame, gid: str, size: tuple[int, int, int], order: tuple[int, int, int]) -> DataFrame:
    """Linear index of each value after its axes are put into x, y, z order.

    ``size`` counts along the stored axes, fastest first; ``order`` says which of x = 1, y = 2, z = 3 each is.
    """
    if sorted(order) != [1, 2, 3] or min(size) < 1:
        raise ValueError("order must be a permutation of 1, 2, 3 and sizes positive")
    stored = Grid(size).index(F.col(gid))
    by_axis = {o: (stored[i], size[i]) for i, o in enumerate(order)}
    target = Grid(tuple(by_axis[a][1] for a in (1, 2, 3)))
    return df.withColumn(gid, target.gid(*[by_axis[a][0] for a in (1, 2, 3)]))


def _cubic_weight(k: Column, t: Column) -> Column:
    """Weight of neighbour k (0 to 3, of which 1 is below) of a Catmull-Rom spline at t."""
    t2, t3 = t * t, t * t * t
    return 0.5 * F.when(k == 0, -t3 + 2 * t2 - t).when(k == 1, 3 * t3 - 5 * t2 + 2).when(k == 2, -3 * t3 + 4 * t2 + t).otherwise(t3 - t2)


def interpolate(
    points: DataFrame, voxel: DataFrame, grid: Grid, point_id: str, axes: Sequence[str] = AXES, value: str = "value"
) -> DataFrame:
    """Tricubic value at each point: point_id, value DOUBLE.

    Every point takes the 64 voxels around it (indices clamped at the edges), joined by linear index and summed with
    separable weights; a point outside the grid counts from index -1, so its value extrapolates. Points share voxels, never
    the grid: nothing is broadcast, and the sum is combined before its shuffle. Points with a null coordinate have null;
    voxels that are missing count 0. ``point_id`` must be unique.
    """
    at = grid.floor_index(*[F.col(a) for a in axes])
    ok = F.lit(True)
    for a in axes:
        ok = ok & F.col(a).isNotNull()
    p = points.where(ok).select(
        point_id, *[F.col(a).alias(f"__p{n}") for a, n in zip(axes, AXES)], *[i.alias(f"__i{n}") for i, n in zip(at, AXES)]
    )
    p = p.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(63))))
    cells, weight = [], F.lit(1.0)
    for j, (a, n, s, o) in enumerate(zip(AXES, grid.size, grid.spacing, grid.origin)):
        k = F.shiftright("__k", 2 * j).bitwiseAND(F.lit(3))
        cells.append(F.least(F.greatest(F.col(f"__i{a}") + k - 1, F.lit(0)), F.lit(n - 1)))
        weight = weight * _cubic_weight(k, (F.col(f"__p{a}") - o - F.col(f"__i{a}") * s) / s)
    p = p.select(point_id, grid.gid(*cells).alias("gid"), weight.alias("w"))
    p = p.groupBy(point_id, "gid").agg(F.sum("w").alias("w"))  # clamped neighbours fall together
    v = voxel.select(F.col("gid").cast("long").alias("gid"), F.col(value).cast("double").alias("v"))
    # the 64 rows a point aren't in the optimizer's estimate, so it isn't left to choose a broadcast
    got = p.join(v.hint("merge"), "gid").groupBy(point_id).agg(F.sum(F.col("w") * F.col("v")).alias("value"))
    return points.select(point_id, ok.alias("__ok")).join(got, point_id, "left").select(
        point_id, F.when(F.col("__ok"), F.coalesce("value", F.lit(0.0))).alias("value")
    )


def stencil(points: DataFrame, grid: Grid, radius: float, axes: Sequence[str] = AXES) -> DataFrame:
    """Each point with every voxel within ``radius`` (included): its columns, gid LONG, distance DOUBLE.

    The voxels come from index arithmetic, axis by axis, so there is no join and no search structure.
    """
    out = points
    for k, (a, n, s, o) in enumerate(zip(axes, grid.size, grid.spacing, grid.origin)):
        lo = F.greatest(F.lit(0), F.ceil((F.col(a) - radius - o) / s - 1e-9)).cast("long")
        hi = F.least(F.lit(n - 1), F.floor((F.col(a) + radius - o) / s + 1e-9)).cast("long")
        out = out.withColumn(f"__i{k}", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))))
        gap = F.col(f"__i{k}") * s + o - F.col(a)
        out = out.withColumn(f"__d{k}", gap * gap + (F.col(f"__d{k - 1}") if k else 0)).where(F.col(f"__d{k}") <= radius * radius)
    return out.select(*points.columns, grid.gid(F.col("__i0"), F.col("__i1"), F.col("__i2")).alias("gid"), F.sqrt("__d2").alias("distance"))


def scatter_add(
    points: DataFrame, grid: Grid, radius: float, potential: Column, keys: Sequence[str] = (), axes: Sequence[str] = AXES
) -> DataFrame:
    """Field of all points on a grid: keys, gid, value. ``potential`` is a Column of the point's columns and ``distance``.

    Contributions are summed by voxel before the shuffle. With ``keys`` (as a blurring width) one job makes all fields.
    Voxels that no point reaches have 0.
    """
    parts = stencil(points, grid, radius, axes).withColumn("__p", potential)
    field = parts.groupBy(*keys, "gid").agg(F.sum("__p").alias("value"))
    every = voxels(points.sparkSession, grid)
    if keys:
        every = points.select(*keys).distinct().withColumn(
            "gid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.n - 1).cast("long")))
        )
    return every.join(field, [*keys, "gid"], "left").select(*keys, "gid", F.coalesce("value", F.lit(0.0)).alias("value"))
