"""Result tables behind the reports on fitted models: lookups, series, comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import gauss
from gridloom.operators import lookup, spatial, stats


def group_parameter(groups: DataFrame, class_key: str, group_key: int, kind: str, which: int = 0, dimension: int = 3) -> float:
    """Amplitude, width or intensity (0, 1, 2) of one group's mean, mdpde or prior line. An unknown group is an error."""
    a, w = gauss.gauss_from_beta(F.col(f"b0_{kind}"), F.col(f"b1_{kind}"), dimension)
    r = groups.where(
        (F.col("class_key") == class_key) & (F.col("group_key") == group_key)
    ).select(gauss.parameter(which, a, w).alias("v")).first()
    if r is None:
        raise KeyError((class_key, group_key))
    return r["v"]


def available(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (class_key, group_key) that exist."""
    return wanted.join(groups.select("class_key", "group_key"), ["class_key", "group_key"], "left_semi")


def members(posterior: DataFrame, class_key: str, group_key: int, outliers_only: bool = False) -> DataFrame:
    m = posterior.where((F.col("class_key") == class_key) & (F.col("group_key") == group_key))
    return m.where("is_outlier") if outliers_only else m


def estimates(fits: DataFrame, keys: Sequence[str], dimension: int = 3) -> DataFrame:
    """Amplitude and width of the least squares and of the robust line."""
    ao, wo = gauss.gauss_from_beta(F.col("b0_ols"), F.col("b1_ols"), dimension)
    a, w = gauss.gauss_from_beta(F.col("b0"), F.col("b1"), dimension)
    return fits.select(
        *keys, ao.alias("amplitude_ols"), wo.alias("width_ols"), a.alias("amplitude"), w.alias("width"),
        gauss.intensity(a, w).alias("intensity")
    )


def posterior_estimates(posterior: DataFrame, keys: Sequence[str], dimension: int = 3) -> DataFrame:
    """Amplitude and width of the posterior line with their standard deviations."""
    b0, b1 = F.col("b0_posterior"), F.col("b1_posterior")
    a, w = gauss.gauss_from_beta(b0, b1, dimension)
    sa, sw = gauss.sigma_from_beta(b0, b1, F.col("v00"), F.col("v11"), F.col("v01"))
    return posterior.select(
        *keys, a.alias("amplitude"), w.alias("width"), sa.alias("sigma_amplitude"), sw.alias("sigma_width"), "distance", "is_outlier"
    )


def group_estimates(groups: DataFrame, keys: Sequence[str], dimension: int = 3) -> DataFrame:
    out = [*keys, "n_members", "n_outliers"]
    for kind in ("mean", "mdpde", "prior"):
        a, w = gauss.gauss_from_beta(F.col(f"b0_{kind}"), F.col(f"b1_{kind}"), dimension)
        out += [a.alias(f"amplitude_{kind}"), w.alias(f"width_{kind}")]
    sa, sw = gauss.sigma_from_beta(F.col("b0_prior"), F.col("b1_prior"), F.col("l00"), F.col("l11"), F.col("l01"))
    return groups.select(*out, sa.alias("sigma_amplitude"), sw.alias("sigma_width"))


def first_member_value(members: DataFrame, group: Sequence[str], member: str, value: str, out: str) -> DataFrame:
    """For each group the value of its first member in order, 0 where that has none."""
    return members.groupBy(*group).agg(F.coalesce(F.min_by(value, member), F.lit(0.0)).alias(out))


def parameter_minimum(fits: DataFrame, atoms: DataFrame, element: int, column: str) -> DataFrame:
    """Least value of an estimate over one element; NaN counts as none."""
    rows = fits.join(atoms.where(F.col("element") == element).select("serial_id"), "serial_id", "left_semi")
    return rows.agg(F.min(F.when(~F.isnan(F.col(column).cast("double")), F.col(column))).alias("minimum"))


def category_counts(atoms: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` by the listed values of ``column``."""
    return atoms.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def in_catalogue_order(groups: DataFrame, catalogue: DataFrame, on: Sequence[str]) -> DataFrame:
    """Group rows with their catalogue ordinal, absent ones left out."""
    return catalogue.join(groups, list(on)).orderBy("ordinal")


def neighbours_and_value(
    points: DataFrame, point_id: str, axes: Sequence[str], radius: float, value: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Neighbour count within ``radius`` (itself included) beside each point's value."""
    return spatial.neighbour_counts(points, point_id, axes, radius, keys).join(points.select(point_id, value), point_id)


def distance_to_centre(points: DataFrame, point_id: str, keys: Sequence[str], axes: Sequence[str], value: str) -> DataFrame:
    c = points.groupBy(*keys).agg(*[F.avg(a).alias(f"__{a}") for a in axes])
    j = points.join(c, list(keys))
    return j.select(point_id, stats.norm(*[F.col(a) - F.col(f"__{a}") for a in axes]).alias("distance"), value)


def paired_groups(rows: DataFrame, first: str, second: str, name: str, on: Sequence[str], value: str, order: str) -> DataFrame:
    """Value of each ``first`` atom beside that of the first ``second`` atom with the same keys."""
    right = rows.where(F.col(name) == second).withColumn("other", F.col(value))
    return lookup.first_match(rows.where(F.col(name) == first), right, on, order, ["other"]).select(order, *on, F.col(value), "other")


def curves(
    fits: DataFrame, keys: Sequence[str], xs: Sequence[float], b0: str = "b0", b1: str = "b1", form: str = "gauss", dimension: int = 3
) -> DataFrame:
    """Fitted curves at the given positions, for all fits at once: keys, x, y.

    ``form`` line: ln v over -d^2 / 2, y = b0 + b1 x; gauss: amplitude times the unit Gaussian of the width in ``dimension``
    dimensions at distance x, both from the line's coefficients (0 where b1 isn't positive)."""
    rows = fits.select(
        *keys, F.col(b0).alias("__b0"), F.col(b1).alias("__b1"), F.explode(F.array(*[F.lit(float(x)) for x in xs])).alias("x")
    )
    if form == "line":
        y = F.col("__b0") + F.col("__b1") * F.col("x")
    elif form == "gauss":
        a, w = gauss.gauss_from_beta(F.col("__b0"), F.col("__b1"), dimension)
        y = F.when(
            w > 0, a * F.pow(2 * math.pi * w * w, F.lit(-dimension / 2)) * F.exp(-F.col("x") * F.col("x") / (2 * w * w))
        ).otherwise(0.0)
    else:
        raise ValueError("form must be line or gauss")
    return rows.select(*keys, "x", y.alias("y"))


def chain_series(rows: DataFrame, value: str, sigma: str | None = None) -> DataFrame:
    """Values by chain and sequence number (a series is sorted by who draws it); negative sequence numbers are left out."""
    cols = ["key_tag", "chain_id", "sequence_id", value] + ([sigma] if sigma else [])
    return rows.where(F.col("sequence_id") >= 0).select(*cols)


def compare_groups(groups: DataFrame, reference_key: str, value: str, sigma: str, rooted: bool = False) -> DataFrame:
    """Each model's group value over the reference model's, with propagated error; zero values and absent groups are left out."""
    ref = groups.where(F.col("key_tag") == reference_key).select(
        "class_key", "group_key", F.col(value).alias("__r"), F.col(sigma).alias("__s")
    )
    j = groups.where(F.col("key_tag") != reference_key).join(ref, ["class_key", "group_key"])
    q, e = gauss.ratio(F.col(value), F.col(sigma), F.col("__r"), F.col("__s"), rooted)
    return j.select("key_tag", "class_key", "group_key", q.alias("ratio"), e.alias("ratio_sigma")).where("ratio is not null and ratio <> 0")


def paired_profiles(
    left: DataFrame, right: DataFrame, keys: Sequence[str], distance: str, value: str, bins: int = 15, high: float = 1.5
) -> DataFrame:
    """Binned medians of two models side by side at equal keys and bins: keys, bin, x, a, b."""
    a, b = (stats.binned_medians(m, keys, distance, value, 0.0, high, bins) for m in (left, right))
    return a.withColumnRenamed("y", "a").join(b.select(*keys, "bin", F.col("y").alias("b")), [*keys, "bin"])


def value_regression(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Line of the right table's values over the left's at equal keys: n, slope, intercept, r2."""
    j = left.select(*on, F.col(value).alias("a")).join(right.select(*on, F.col(value).alias("b")), list(on))
    s, i, r = stats.linear_fit(F.col("a"), F.col("b"))
    return j.agg(F.count(F.lit(1)).alias("n"), s.alias("slope"), i.alias("intercept"), r.alias("r2"))
