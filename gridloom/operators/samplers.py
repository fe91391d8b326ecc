"""Sample points around entities: on spheres, cylinders and plane lattices. Draws are counters hashed with a seed, so that
they don't depend on partitions, order or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def lcg(value: Column, step: Column, seed: int = 0) -> Column:
    """A linear congruential draw in [0, 1) of small integers, the same in any SQL engine."""
    return F.pmod(
        F.pmod(value, F.lit(1 << 20)) * F.lit(1103515245) + step * F.lit(12345) + F.lit(seed), F.lit(1 << 31)
    ).cast("double") / F.lit(float(1 << 31))


def _expand(df: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("at least one sample")
    return df.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sphere(
    df: DataFrame, key: str, n: int, low: float, high: float, seed: int = 0, axes: tuple[str, str, str] = ("x", "y", "z")
) -> DataFrame:
    """n points a row at distances uniform in [low, high] (not uniform in volume) and uniform directions: adds sample_no,
    distance, px, py, pz."""
    if not 0 <= low <= high:
        raise ValueError("0 <= low <= high")
    s = _expand(df, n)
    u = [uniform(seed, F.col(key), F.col("sample_no"), F.lit(i)) for i in range(3)]
    s = s.withColumns({"distance": F.lit(low) + u[0] * (high - low), "__c": 2 * u[1] - 1, "__f": 2 * math.pi * u[2]})
    flat = F.sqrt(1 - F.col("__c") * F.col("__c"))
    d = F.col("distance")
    return s.withColumns(
        {
            "px": F.col(axes[0]) + d * flat * F.cos("__f"), "py": F.col(axes[1]) + d * flat * F.sin("__f"),
            "pz": F.col(axes[2]) + d * F.col("__c")
        }
    ).drop("__c", "__f")


def _frame(s: DataFrame, axis: tuple[str, str, str]) -> DataFrame:
    """Adds the unit axis (n0..n2) and two units across it (a0..a2, b0..b2); a zero axis counts as z."""
    ax = [F.col(c).cast("double") for c in axis]
    length = F.sqrt(ax[0] * ax[0] + ax[1] * ax[1] + ax[2] * ax[2])
    s = s.withColumns({f"__n{i}": F.when(length > 0, c / length).otherwise(1.0 if i == 2 else 0.0) for i, c in enumerate(ax)})
    # across: n x z, or n x x where the axis is z
    up = F.abs("__n2") < 0.999
    a = [
        F.when(up, F.col("__n1")).otherwise(0.0), F.when(up, -F.col("__n0")).otherwise(F.col("__n2")),
        F.when(up, 0.0).otherwise(-F.col("__n1"))
    ]
    norm = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    s = s.withColumns({f"__a{i}": c / norm for i, c in enumerate(a)})
    cross = lambda i, j: F.col(f"__n{i}") * F.col(f"__a{j}") - F.col(f"__n{j}") * F.col(f"__a{i}")
    return s.withColumns({"__b0": cross(1, 2), "__b1": cross(2, 0), "__b2": cross(0, 1)})


def _place(s: DataFrame, axes: tuple[str, str, str], u: Column, v: Column, h: Column, keep: list[str]) -> DataFrame:
    p = [F.col(c) + u * F.col(f"__a{i}") + v * F.col(f"__b{i}") + h * F.col(f"__n{i}") for i, c in enumerate(axes)]
    return s.select(*keep, p[0].alias("px"), p[1].alias("py"), p[2].alias("pz"))


def cylinder(
    df: DataFrame, key: str, n: int, low: float, high: float, height: float, seed: int = 0, axes: tuple[str, str, str] = ("x", "y", "z"),
    axis: tuple[str, str, str] = ("vx", "vy", "vz")
) -> DataFrame:
    """n points a row within the shell low <= r <= high around an axis (r^2 uniform) and half ``height`` along it to both sides:
    adds sample_no, distance (from the axis), px, py, pz."""
    if not 0 <= low <= high or height < 0:
        raise ValueError("0 <= low <= high and a height of at least 0")
    s = _frame(_expand(df, n), axis)
    u = [uniform(seed, F.col(key), F.col("sample_no"), F.lit(i)) for i in range(3)]
    s = s.withColumns(
        {"distance": F.sqrt(F.lit(low * low) + u[0] * (high * high - low * low)), "__f": 2 * math.pi * u[1], "__h": (u[2] - 0.5) * height}
    )
    d = F.col("distance")
    return _place(s, axes, d * F.cos("__f"), d * F.sin("__f"), F.col("__h"), [*df.columns, "sample_no", "distance"])


def plane(
    df: DataFrame, m: int, width: float, axes: tuple[str, str, str] = ("x", "y", "z"), axis: tuple[str, str, str] = ("vx", "vy", "vz")
) -> DataFrame:
    """The m x m lattice of edge ``width`` centred on each row in the plane across its axis, row by row: adds sample_no, row,
    column, distance, px, py, pz."""
    s = _frame(_expand(df, m * m), axis)
    step = width / (m - 1) if m > 1 else 0.0
    s = s.withColumns({"row": F.floor(F.col("sample_no") / m).cast("int"), "column": F.pmod("sample_no", F.lit(m)).cast("int")})
    s = s.withColumns(
        {"__u": F.col("column") * step - (width / 2 if m > 1 else 0.0), "__v": F.col("row") * step - (width / 2 if m > 1 else 0.0)}
    )
    s = s.withColumn("distance", F.sqrt(F.col("__u") * F.col("__u") + F.col("__v") * F.col("__v")))
    return _place(s, axes, F.col("__u"), F.col("__v"), F.lit(0.0), [*df.columns, "sample_no", "row", "column", "distance"])


def viewing_frame(entities: DataFrame, neighbours: DataFrame, keys: list[str], axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """For each entity the normal (vx, vy, vz) of the plane through its first non-degenerate bond and the z direction.

    ``neighbours``: keys, order, nx, ny, nz (the other end's position). The bond direction u crossed with (0, 0, 1), or with
    (1, 0, 0) where they are parallel; entities without a bond get (0, 0, 1).
    """
    d = [F.col(n) - F.col(a) for n, a in zip(("nx", "ny", "nz"), axes)]
    j = entities.select(*keys, *axes).join(neighbours, list(keys)).where(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] > 1e-12)
    first = j.groupBy(*keys).agg(F.min_by(F.struct(*[c.alias(f"u{i}") for i, c in enumerate(d)]), "order").alias("u"))
    u0, u1, u2 = F.col("u.u0"), F.col("u.u1"), F.col("u.u2")
    steep = u0 * u0 + u1 * u1 < 1e-12
    v = {"vx": F.when(steep, 0.0).otherwise(u1), "vy": F.when(steep, u2).otherwise(-u0), "vz": F.when(steep, -u1).otherwise(0.0)}
    e = entities.join(first, list(keys), "left")
    return e.select(*entities.columns, *[F.coalesce(c, F.lit(1.0 if n == "vz" else 0.0)).alias(n) for n, c in v.items()])
