"""Gaussian profiles and their linear form: ln v = b0 + b1 (-d^2 / 2). All take and return Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def response(r: Column, width: float, dimension: int = 3) -> Column:
    """Unit Gaussian at distance r; the width must be positive."""
    if width <= 0:
        raise ValueError("width must be positive")
    return F.lit((TWO_PI * width * width) ** (-dimension / 2)) * F.exp(-r * r / F.lit(2 * width * width))


def linearize(df: DataFrame, distance: str, value: str, low: float, high: float) -> DataFrame:
    """Adds x0 = 1, x1 = -d^2 / 2, y = ln v and drops rows outside low <= d <= high or without a positive value."""
    d, v = F.col(distance).cast("double"), F.col(value).cast("double")
    return df.where((d >= low) & (d <= high) & (v > 0)).select("*", F.lit(1.0).alias("x0"), (-0.5 * d * d).alias("x1"), F.ln(v).alias("y"))


def linearize_entities(entities: DataFrame, samples: DataFrame, key: str, distance: str, value: str, low: float, high: float) -> DataFrame:
    """linearize(), with one zero row for each entity that keeps no sample."""
    rows = linearize(samples, distance, value, low, high).select(key, "x0", "x1", "y")
    return entities.select(key).join(rows, key, "left").select(key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x0", "x1", "y")])


def beta_from_gauss(amplitude: Column, width: Column) -> tuple[Column, Column]:
    """(b0, b1) of amplitude and width; zeros where the amplitude isn't positive or the width is 0."""
    ok = (amplitude > 0) & (width != 0)
    safe_w = F.when(ok, width)
    b0 = F.ln(F.when(ok, amplitude)) - 1.5 * F.ln(TWO_PI * safe_w * safe_w)
    return F.coalesce(b0, F.lit(0.0)), F.coalesce(1 / (safe_w * safe_w), F.lit(0.0))


def gauss_from_beta(b0: Column, b1: Column, dimension: int = 3) -> tuple[Column, Column]:
    """(amplitude, width); zeros where b1 isn't positive."""
    ok = F.when(b1 > 0, b1)
    return F.coalesce(F.exp(b0) * F.pow(TWO_PI / ok, F.lit(dimension / 2)), F.lit(0.0)), F.coalesce(F.pow(ok, F.lit(-0.5)), F.lit(0.0))


def sigma_from_beta(b0: Column, b1: Column, v00: Column, v11: Column, v01: Column) -> tuple[Column, Column]:
    """Standard deviations (not variances) of amplitude and width by the delta method, 3-D form also for 2-D profiles."""
    ok = F.when(b1 > 0, b1)
    amplitude = F.lit(TWO_PI**3) * F.exp(2 * b0) * F.pow(ok, F.lit(-5.0)) * (ok * ok * v00 + 2.25 * v11 - 3 * ok * v01)
    return F.coalesce(F.sqrt(amplitude), F.lit(0.0)), F.coalesce(F.sqrt(0.25 * F.pow(ok, F.lit(-3.0)) * v11), F.lit(0.0))


def intensity(amplitude: Column, width: Column) -> Column:
    w = F.when(width != 0, width)
    return F.coalesce(amplitude * F.pow(TWO_PI * w * w, F.lit(-1.5)), F.lit(0.0))


def intensity_sigma(amplitude: Column, sigma_a: Column, width: Column, sigma_w: Column) -> Column:
    w = F.when(width != 0, width)
    return F.sqrt(
        F.pow(F.pow(TWO_PI * w * w, F.lit(-1.5)) * sigma_a, F.lit(2.0)) + F.pow(
            F.lit(-3 * TWO_PI**-1.5) * amplitude * F.pow(w, F.lit(-4.0)) * sigma_w, F.lit(2.0)
        )
    )


def parameter(which: int, amplitude: Column, width: Column) -> Column:
    """0 amplitude, 1 width, 2 intensity."""
    return (amplitude, width, intensity(amplitude, width))[which]


def ratio(y: Column, sigma_y: Column, r: Column, sigma_r: Column, rooted: bool = False) -> tuple[Column, Column]:
    """y / r and its propagated error; ``rooted`` takes the square roots of the errors first. Null for zero y or r."""
    sy, sr = (F.sqrt(sigma_y), F.sqrt(sigma_r)) if rooted else (sigma_y, sigma_r)
    q = F.try_divide(y, r)
    return q, q * F.sqrt(F.pow(F.try_divide(sy, y), F.lit(2.0)) + F.pow(F.try_divide(sr, r), F.lit(2.0)))


def normalized_residual(estimate: Column, truth: Column) -> Column:
    return F.try_divide(estimate - truth, truth)
