"""Scalar and grouped statistics as aggregate Columns, with defined results for empty input."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ordering import percentiles


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def sd(c: Column) -> Column:
    """Sample standard deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def minimum(c: Column) -> Column:
    """NaN for empty input, like maximum()."""
    return F.coalesce(F.min(c), F.lit(float("nan")))


def maximum(c: Column) -> Column:
    return F.coalesce(F.max(c), F.lit(float("nan")))


def percentile(c: Column, p: float) -> Column:
    """Exact, between ranks linear at p (n - 1); 0 for p <= 0 or empty input, the maximum for p >= 1. The aggregate holds a
    group's distinct values in one task: for large groups use ordering.percentiles()."""
    if p <= 0:
        return F.lit(0.0)
    return F.coalesce(F.max(c) if p >= 1 else F.percentile(c, F.lit(p)), F.lit(0.0))


def median(c: Column) -> Column:
    return F.coalesce(F.median(c), F.lit(0.0))


def percentile_range(c: Column, low: float = 0.01, high: float = 0.99) -> tuple[Column, Column]:
    return percentile(c, low), percentile(c, high)


def value_range(c: Column) -> tuple[Column, Column]:
    return F.coalesce(F.min(c), F.lit(0.0)), F.coalesce(F.max(c), F.lit(0.0))


def scaled(bounds: tuple[Column, Column], factor: float) -> tuple[Column, Column]:
    """Bounds moved outwards by factor x their distance."""
    lo, hi = bounds
    return lo - factor * (hi - lo), hi + factor * (hi - lo)


def norm(*components: Column) -> Column:
    total = components[0] * components[0]
    for c in components[1:]:
        total = total + c * c
    return F.sqrt(total)


def normalize_by_sd(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``value`` divided by the sample sd of its group, not centred; unchanged where the sd is 0. The sd table has one row
    a group and is joined by size."""
    s = df.groupBy(*keys).agg(sd(F.col(value)).alias("__sd"))
    j = df.join(s, list(keys)) if keys else df.withColumn("__sd", F.lit(s.first()[0]))
    return j.withColumn(value, F.when(F.col("__sd") == 0, F.col(value)).otherwise(F.col(value) / F.col("__sd"))).drop("__sd")


def binned_medians(
    df: DataFrame, keys: Sequence[str], distance: str, value: str, low: float = 0.0, high: float = 1.5, bins: int = 15
) -> DataFrame:
    """Median of ``value`` in each of ``bins`` distance bins for every key: keys, bin INT, x, y DOUBLE, empty bins 0.

    A bin's index ignores ``low`` while its centre uses it (they agree at low = 0); values outside all bins are left out. Runs
    jobs; bins of any size.
    """
    step = (high - low) / bins
    b = F.floor(F.col(distance) / F.lit(step)).cast("int")
    got = percentiles(
        df.select(*keys, b.alias("bin"), F.col(value)).where(F.col("bin").between(0, bins - 1)), [*keys, "bin"], value, {"y": 0.5}
    )
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(got, [*keys, "bin"], "left").select(
        *keys, "bin", (F.lit(low) + (F.col("bin") + 0.5) * step).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")
    )


def near_centre_mean(d: Column, v: Column, radius: float = 0.05) -> Column:
    return F.coalesce(F.avg(F.when(d <= radius, v)), F.lit(0.0))


def moments(d: Column, v: Column, reach: float = 1.0) -> tuple[Column, Column]:
    """Zeroth and second moment over positive values within reach; null if none qualify."""
    ok = (v > 0) & (d <= reach)
    m0 = F.avg(F.when(ok, v))
    return m0, F.sqrt(F.try_divide(F.avg(F.when(ok, v * d * d)), m0) / 3)


def q_score(
    df: DataFrame, keys: Sequence[str], distance: str, value: str, amplitude: Column | float = 0.05, width: Column | float = 0.6,
    offset: float = -0.005
) -> DataFrame:
    """Correlation of the values with a reference Gaussian profile, from six sums; 0 where either is constant."""
    as_col = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    d, v = F.col(distance).cast("double"), F.col(value).cast("double")
    ref = as_col(amplitude) * F.exp(-0.5 * F.pow(d / as_col(width), F.lit(2.0))) + offset
    s = df.select(*keys, v.alias("v"), ref.alias("f")).where("v is not null and f is not null").groupBy(*keys).agg(
        F.covar_pop("v", "f").alias("c"), F.var_pop("v").alias("a"), F.var_pop("f").alias("b")
    )
    return s.select(
        *keys, F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / (F.sqrt("a") * F.sqrt("b"))).otherwise(0.0).alias("q_score")
    )


def linear_fit(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Slope, intercept and R^2 (1 for constant y); null for constant x."""
    return F.regr_slope(y, x), F.regr_intercept(y, x), F.regr_r2(y, x)


def histogram(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in equal bins of [low, high): keys, bin INT from 0, n LONG; values outside are left out, empty bins have no row."""
    b = F.floor((F.col(value) - low) / F.lit((high - low) / bins)).cast("int")
    return df.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(
    df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: tuple[int, int]
) -> DataFrame:
    def b(c: str, r: tuple[float, float], n: int) -> Column:
        return F.floor((F.col(c) - r[0]) / F.lit((r[1] - r[0]) / n)).cast("int")

    inside = (F.col(x) >= x_range[0]) & (F.col(x) < x_range[1]) & (F.col(y) >= y_range[0]) & (F.col(y) < y_range[1])
    return df.where(inside).groupBy(
        b(x, x_range, bins[0]).alias("bin_x"), b(y, y_range, bins[1]).alias("bin_y")
    ).agg(F.count(F.lit(1)).alias("n"))


def spatial_summary(df: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Centre (mean) and range of each axis, and the length of the range's diagonal."""
    aggs = [f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.avg, "centre"), (F.min, "low"), (F.max, "high"))]
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    return s.withColumn("length", norm(*[F.col(f"high_{a}") - F.col(f"low_{a}") for a in axes]))


def relative_position(fraction: Column, low: Column, high: Column) -> Column:
    """Absolute coordinate of a fraction of the range."""
    return low + fraction * (high - low)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
