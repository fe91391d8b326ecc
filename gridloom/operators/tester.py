"""Accuracy of the estimators on simulated profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.group_model import MEMBER_FLOOR, group_mean
from gridloom.operators.robust import MAX_ITERATIONS, TOLERANCE, fit_segments, validate

#: Levels and parts that an alpha is trained with, of lines and of groups.
LINE_ALPHAS, LINE_FOLDS = tuple(i / 10 for i in range(6)), 5
GROUP_ALPHAS, GROUP_SPLITS = tuple(i / 10 for i in range(11)), 10
#: Studies of either kind with their replicas and points (members).
LINE_STUDIES = {"benchmark": (1000, 1000), "data_outlier": (100, 1000), "alpha_data": (100, 1000)}
GROUP_STUDIES = {"member_outlier": (100, 100), "alpha_member": (100, 100)}
#: Replicas a task.
TASK_REPLICAS = 50


def _rng(seed: int, *parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *parts])))


def trained_line_alpha(x: np.ndarray, y: np.ndarray) -> float:
    """The level of least summed |fit(fold) - fit(rest)| over the folds i mod LINE_FOLDS, the first of equal ones."""
    fold = np.arange(len(x)) % LINE_FOLDS
    sides = [np.flatnonzero(s) for f in range(LINE_FOLDS) for s in (fold == f, fold != f)]
    used = [i for i, s in enumerate(sides) if len(s)]
    order, starts = np.concatenate(sides), np.cumsum([0, *[len(sides[i]) for i in used]])[:-1]
    errors = []
    for alpha in LINE_ALPHAS:
        f, b = fit_segments(x[order], y[order], starts, alpha), np.zeros((2 * LINE_FOLDS, 2))
        b[used] = np.stack([f["b0"], f["b1"]], 1)
        errors.append(np.sqrt(((b[::2] - b[1::2]) ** 2).sum(1)).sum())
    return LINE_ALPHAS[int(np.argmin(errors))]


def group_means(beta: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """The means of group_mean() for many groups of one size (groups x members x 2), each with its alpha."""
    n = beta.shape[1]
    mu, open_ = np.median(beta, 1), np.arange(len(beta))
    if n == 1:
        return mu
    spread = np.tile(np.eye(2), (len(beta), 1, 1))
    for _ in range(MAX_ITERATIONS):
        s = spread[open_]
        det = s[:, 0, 0] * s[:, 1, 1] - s[:, 0, 1] ** 2
        odd = ~(det > 1e-12 * s[:, 0, 0] * s[:, 1, 1])
        for i in open_[odd]:
            mu[i] = group_mean(beta[i], float(alphas[i]))[0]
        open_, s, det = open_[~odd], s[~odd], det[~odd]
        if not len(open_):
            break
        b, a, m = beta[open_], alphas[open_], mu[open_]
        r = b - m[:, None]
        d = (
            r[..., 0] ** 2 * s[:, 1, 1, None] - 2 * r[..., 0] * r[..., 1] * s[:, 0, 1, None] + r[..., 1] ** 2 * s[:, 0, 0, None]
        ) / det[:, None]
        w = np.maximum(np.exp(-0.5 * a[:, None] * d), MEMBER_FLOOR / n)
        new = (b * w[..., None]).sum(1) / w.sum(1)[:, None]
        r = b - new[:, None]
        den = w.sum(1) - n * a * (1 + a) ** -2.0
        fine = den > 0
        s = np.einsum("gni,gnj->gij", r * w[..., None], r) / np.where(fine, den, 1.0)[:, None, None]
        spread[open_] = np.where(fine[:, None, None], s, np.eye(2))
        mu[open_] = new
        open_ = open_[~(((new - m) ** 2).sum(1) < TOLERANCE)]
        if not len(open_):
            break
    return mu


def trained_group_alpha(beta: np.ndarray, g: np.random.Generator) -> float:
    """The level of least summed |mean(half) - mean(other half)| over GROUP_SPLITS random halvings, the first of equal ones."""
    half = len(beta) // 2
    if not half:
        return GROUP_ALPHAS[0]
    mixed = np.stack([beta[g.permutation(len(beta))] for _ in range(GROUP_SPLITS)])
    k, levels = len(GROUP_ALPHAS), np.repeat(GROUP_ALPHAS, GROUP_SPLITS)
    a, b = (group_means(np.tile(side, (k, 1, 1)), levels) for side in (mixed[:, :half], mixed[:, half:]))
    return GROUP_ALPHAS[int(np.argmin(np.sqrt(((a - b) ** 2).sum(1)).reshape(k, GROUP_SPLITS).sum(1)))]


def _jobs(scenarios: DataFrame, replicas: int) -> DataFrame:
    jobs = scenarios.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return jobs.repartition(math.ceil(max(1, scenarios.count()) * replicas / TASK_REPLICAS))


def profile_residuals(
    spark: SparkSession, scenarios: DataFrame, replicas: int, points: int, seed: int = 0, amplitude: float = 1.0, width: float = 0.5,
    fit_range: tuple[float, float] = (0.0, 1.0)
) -> DataFrame:
    """Normalized residuals of amplitude and width for each scenario and replica.

    ``scenarios``: scenario INT, alpha, noise, outlier_share DOUBLE. A replica is a Gaussian profile at ``points`` distances in
    ``fit_range`` whose log carries noise; a share of the points is replaced by outliers. Every replica has a seed of its own.
    Result: scenario, replica, method (ols, robust, and trained: robust with the alpha trained on the replica), amplitude_residual,
    width_residual.
    """
    if replicas < 1 or points < 2:
        raise ValueError("at least one replica and two points")
    b1 = 1 / width**2
    b0 = math.log(amplitude) - 1.5 * math.log(2 * math.pi * width**2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                g = _rng(seed, r.scenario, r.replica)
                d = g.uniform(*fit_range, points)
                x = -0.5 * d * d
                y = b0 + b1 * x + g.normal(0, r.noise, points)
                bad = g.random(points) < r.outlier_share
                y[bad] = b0 + g.normal(3, 1, bad.sum())
                f = fit_segments(x, y, np.array([0]), r.alpha)
                out = []
                t = fit_segments(x, y, np.array([0]), trained_line_alpha(x, y))
                for method, c0, c1 in (
                    ("ols", f["b0_ols"][0], f["b1_ols"][0]), ("robust", f["b0"][0], f["b1"][0]), ("trained", t["b0"][0], t["b1"][0])
                ):
                    a, w = (math.exp(c0) * (2 * math.pi / c1) ** 1.5, c1**-0.5) if c1 > 0 else (0.0, 0.0)
                    out.append((r.scenario, r.replica, method, (a - amplitude) / amplitude, (w - width) / width))
                yield pd.DataFrame(out, columns=["scenario", "replica", "method", "amplitude_residual", "width_residual"])

    for r in scenarios.select("alpha").distinct().collect():
        validate(r["alpha"])
    jobs = _jobs(scenarios, replicas)
    return jobs.select("scenario", "alpha", "noise", "outlier_share", "replica").mapInPandas(
        run, "scenario int, replica int, method string, amplitude_residual double, width_residual double"
    )


def member_residuals(
    spark: SparkSession, scenarios: DataFrame, replicas: int, members: int, seed: int = 0, mean: tuple[float, float] = (1.0, 4.0),
    spread: tuple[float, float] = (0.1, 0.3)
) -> DataFrame:
    """Residuals of a group's mean line when a share of its members are outliers: scenario, replica, method (mean, robust, trained),
    b0_residual, b1_residual. ``scenarios``: scenario, alpha, outlier_share, outlier_shift."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                g = _rng(seed, r.scenario, r.replica)
                beta = g.normal(mean, spread, (members, 2))
                bad = g.random(members) < r.outlier_share
                beta[bad] += r.outlier_shift
                robust = group_mean(beta, r.alpha)[0]
                trained = group_mean(beta, trained_group_alpha(beta, g))[0]
                yield pd.DataFrame(
                    [
                        (r.scenario, r.replica, m, (v[0] - mean[0]) / mean[0], (v[1] - mean[1]) / mean[1]) for m,
                        v in (("mean", beta.mean(0)), ("robust", robust), ("trained", trained))
                    ],
                    columns=["scenario", "replica", "method", "b0_residual", "b1_residual"]
                )

    jobs = _jobs(scenarios, replicas)
    return jobs.select("scenario", "alpha", "outlier_share", "outlier_shift", "replica").mapInPandas(
        run, "scenario int, replica int, method string, b0_residual double, b1_residual double"
    )


def summarize(residuals: DataFrame) -> DataFrame:
    """Mean and sample deviation of each residual by scenario and method."""
    cols = [c for c in residuals.columns if c.endswith("_residual")]
    return residuals.groupBy("scenario", "method").agg(
        F.count(F.lit(1)).alias("n"),
        *[x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_sd"))]
    )


def scenario_table(spark: SparkSession, name: str) -> DataFrame:
    """The parameter grids of the named studies: benchmark, data_outlier, member_outlier, alpha_data, alpha_member."""
    few, many = [i / 40 for i in range(9)], [i / 20 for i in range(10)]
    if name == "benchmark":
        rows = [(0.1, 1.0, 0.0)]
    elif name == "data_outlier":
        rows = [(0.1, s, o) for s in (0.1, 0.2, 0.3) for o in few]
    elif name == "alpha_data":
        rows = [(a, s, o) for a in (0.1, 0.4) for s in (0.1, 0.2, 0.3) for o in many]
    elif name in ("member_outlier", "alpha_member"):
        alphas, shares = ((0.2,), few) if name == "member_outlier" else ((0.2, 0.5), many)
        rows = [(a, o, shift) for a in alphas for shift in (1.0, 3.0) for o in shares]
        return spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)], "scenario int, alpha double, outlier_share double, outlier_shift double"
        )
    else:
        raise ValueError(f"no such study: {name}")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "scenario int, alpha double, noise double, outlier_share double")
