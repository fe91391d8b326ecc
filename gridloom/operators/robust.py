"""Robust regression y = b0 + b1 x for many entities by minimum density power divergence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.operators.ordering import numbered
from gridloom.operators.skew import bounded_join
from gridloom.session import materialize

MAX_ITERATIONS = 100
TOLERANCE = 1e-5
WEIGHT_FLOOR = 1e-8
#: Rows of an entity up to which a worker fits it in memory; larger ones are fitted by sums over the cluster.
KERNEL_ROWS = 1_000_000
HUGE, TINY = float(np.finfo(float).max), float(np.finfo(float).tiny)

# Outcomes of a fit.
OK, FEW, UNFINISHED, FALLBACK, SINGLE = "SUCCESS", "INSUFFICIENT_DATA", "MAX_ITERATIONS_REACHED", "NUMERICAL_FALLBACK", "SINGLE_MEMBER"

FIT_FIELDS = "n long, b0_ols double, b1_ols double, b0 double, b1 double, sigma2 double, status string, iterations int, g00 double, g01 double, g11 double, m0 double, m1 double"


def validate(alpha: float, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE, floor: float = WEIGHT_FLOOR) -> None:
    if not math.isfinite(alpha) or alpha < 0:
        raise ValueError("alpha must be finite and not negative")
    if max_iterations <= 0:
        raise ValueError("max_iterations must be positive")
    if not tolerance >= 0:
        raise ValueError("tolerance must not be negative")
    if not floor > 0:
        raise ValueError("the weight floor must be positive")


def solve2(a00, a01, a11, c0, c1):
    """Symmetric 2 x 2 systems, elementwise; the least-norm solution where one is singular."""
    det = a00 * a11 - a01 * a01
    scale = np.maximum(np.abs(a00 * a11), np.abs(a01 * a01))
    fine = np.abs(det) > 1e-13 * scale
    safe = np.where(fine, det, 1.0)
    x0, x1 = (a11 * c0 - a01 * c1) / safe, (a00 * c1 - a01 * c0) / safe
    for i in np.flatnonzero(~fine):
        p = np.linalg.pinv(np.array([[a00[i], a01[i]], [a01[i], a11[i]]]), hermitian=True) @ np.array([c0[i], c1[i]])
        x0[i], x1[i] = p
    return x0, x1


def fit_segments(
    x: np.ndarray, y: np.ndarray, starts: np.ndarray, alpha: float, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE,
    floor: float = WEIGHT_FLOOR
) -> dict[str, np.ndarray]:
    """All entities of sorted arrays at once; ``starts`` are the first rows of the entities. Converged ones are left alone."""
    total = len(x)
    sizes = np.diff(np.r_[starts, total])
    m = len(starts)
    seg = np.repeat(np.arange(m), sizes)
    add = lambda v: np.add.reduceat(v, starts)

    def weighted(w, v):
        wx = w * x
        return solve2(add(w), add(wx), add(wx * x), add(w * v), add(wx * v))

    few = sizes <= 1
    with np.errstate(all="ignore"):
        # every solution is the line so far and a correction from its residuals, which keeps the digits of nearly exact fits
        b0, b1 = weighted(np.ones(total), y)
        d0, d1 = weighted(np.ones(total), y - b0[seg] - b1[seg] * x)
        b0, b1 = b0 + d0, b1 + d1
        ols = b0.copy(), b1.copy()
        r = y - b0[seg] - b1[seg] * x
        s2 = add(r * r) / np.maximum(1, sizes - 1)
        w = np.ones(total)
        open_, steps = ~few, np.zeros(m, int)
        done = few.copy()
        for _ in range(max_iterations):
            if not open_.any():
                break
            base = np.where(np.isfinite(s2) & (s2 > 0), s2, floor)
            r = y - b0[seg] - b1[seg] * x
            nw = np.ones(total) if alpha == 0 else np.exp(-0.5 * alpha * r * r / base[seg])
            nw = np.maximum(np.where(np.isfinite(nw), nw, floor), floor)
            w = np.where(open_[seg], nw, w)
            d0, d1 = weighted(w, r)
            n0, n1 = b0 + d0, b1 + d1
            r = y - n0[seg] - n1[seg] * x
            den = add(w) - sizes * alpha * (1 + alpha) ** -1.5
            ns = add(w * r * r) / np.where(den > 0, den, TINY)
            ns = np.where(np.isfinite(ns) & (ns > 0), ns, HUGE)
            moved = (n0 - b0) ** 2 + (n1 - b1) ** 2
            b0, b1, s2 = np.where(open_, n0, b0), np.where(open_, n1, b1), np.where(open_, ns, s2)
            steps += open_
            ended = open_ & (moved < tolerance)
            done |= ended
            open_ &= ~ended
        inverse = 1 / w
        cov = sizes[seg] * s2[seg] * inverse / add(inverse)[seg]
        cov = np.where(np.isfinite(cov) & (cov > 0), cov, 1.0)
    c = 1 / cov
    g = add(c), add(c * x), add(c * x * x), add(c * y), add(c * x * y)
    status = np.where(few, FEW, np.where(s2 == HUGE, FALLBACK, np.where(done, OK, UNFINISHED)))
    zero = lambda v: np.where(few, 0.0, v)
    return {
        "n": sizes, "b0_ols": zero(ols[0]), "b1_ols": zero(ols[1]), "b0": zero(b0), "b1": zero(b1), "sigma2": np.where(few, HUGE, s2),
        "status": status, "iterations": steps.astype(np.int32),
        "g00": g[0], "g01": g[1], "g11": g[2], "m0": g[3], "m1": g[4],
    }


def by_segments(
    keys: Sequence[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """mapInPandas function over rows sorted by ``keys`` that hands whole entities to ``run``, many at a time."""
    keys = list(keys)

    def starts_of(df: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(df), bool)
        change[0] = True
        for k in keys:
            v = df[k]
            null = v.isna().to_numpy()
            change[1:] |= (v.to_numpy()[1:] != v.to_numpy()[:-1]) & ~(null[1:] & null[:-1])
        return np.flatnonzero(change)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # parts of one entity
        for b in batches:
            if not len(b):
                continue
            if held and len(starts_of(pd.concat([held[0].iloc[:1], b.iloc[[0, -1]]], ignore_index=True))) == 1:
                held.append(b)  # the whole batch goes on with it
                continue
            df = pd.concat([*held, b], ignore_index=True) if held else b
            at = starts_of(df)
            cut = int(at[-1])
            if cut:
                yield run(df.iloc[:cut].reset_index(drop=True), at[:-1])
            held = [df.iloc[cut:].reset_index(drop=True)]
        if held:
            df = pd.concat(held, ignore_index=True)
            yield run(df, starts_of(df))

    return each


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def split_large(rows: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows of the keys with at most ``limit`` rows, the keys with more (keys, __n), and how many these are: at most a
    limit-th of the rows. Runs a job."""
    keys = list(keys)
    big = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit))
    n_big = big.count()
    return (bounded_join(rows, big, same_keys(rows, big, keys), n_big, "left_anti") if n_big else rows), big, n_big


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def fit_local(
    df: DataFrame, keys: Sequence[str], x: str, y: str, alpha: float, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE,
    floor: float = WEIGHT_FLOOR, kernel_rows: int = KERNEL_ROWS
) -> DataFrame:
    """One robust line for each entity: keys and FIT_FIELDS, sigma2 being the residual variance.

    Starting from least squares, rows are weighted exp(-alpha r^2 / 2 sigma2) (at least ``floor``), the weighted line and
    variance recomputed until the squared change of (b0, b1) is below ``tolerance``. g and m are the information matrix and
    vector under the final row variances: five sums that stand for the entity's rows in the group model.

    Rows are hashed and sorted by entity and fitted in batches of many entities at once. Entities above ``kernel_rows`` rows
    (at most rows / kernel_rows of them) are fitted by weighted sums over the cluster instead, a scan an iteration, so that
    none is gathered in one task. Rows with a null or non-finite x or y are left out; an entity with one row has zeros and
    INSUFFICIENT_DATA. Null keys are an entity; repeated rows count each. Counts the rows of each entity first.
    """
    validate(alpha, max_iterations, tolerance, floor)
    keys = list(keys)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(
        *keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")
    ).where(finite(F.col("__x")) & finite(F.col("__y")))
    small, big, n_big = split_large(rows, keys, kernel_rows)

    def run(seg: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = fit_segments(seg["__x"].to_numpy(), seg["__y"].to_numpy(), starts, alpha, max_iterations, tolerance, floor)
        return pd.concat([seg[keys].iloc[starts].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    schema = f"{_key_schema(df, keys)}, {FIT_FIELDS}"
    fits = small.repartition(*keys).sortWithinPartitions(*keys, "__x", "__y").mapInPandas(by_segments(keys, run), schema)
    if n_big:
        hot = bounded_join(rows, big, same_keys(rows, big, keys), n_big, "left_semi")
        fits = fits.unionByName(fit_by_sums(hot, keys, "__x", "__y", alpha, max_iterations, tolerance, floor))
    return fits


_STATE = "n long, b0_ols double, b1_ols double, b0 double, b1 double, sigma2 double, status string, iterations int, s double, sx double, sxx double, sy double, sxy double, si double"


def fit_by_sums(
    df: DataFrame, keys: Sequence[str], x: str, y: str, alpha: float, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE,
    floor: float = WEIGHT_FLOOR
) -> DataFrame:
    """fit_local() for entities of many rows: every iteration is one scan of those still open, whose weighted sums are combined
    before the shuffle. The state of the entities is a table, so their number isn't bounded either.

    Sums are taken over the residuals to the line so far and give its correction; so the residual variance isn't the
    difference of large numbers, and the result is that of the kernel to rounding. Runs a job an iteration.
    """
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")
    )
    key_schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    start = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    state = materialize(
        start.select(
            *names, "n", *[F.lit(0.0).alias(c) for c in ("b0_ols", "b1_ols", "b0", "b1", "sigma2")], F.lit("START").alias("status"),
            F.lit(0).alias("iterations"), *[F.lit(0.0).alias(c) for c in ("s", "sx", "sxx", "sy", "sxy", "si")]
        )
    )

    def corrected(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New line and weighted residual sum from the sums over the residuals to the old one."""
        v = {c: g[c].to_numpy(float) for c in ("b0", "b1", "s", "sx", "sxx", "sr", "sxr", "srr")}
        det, scale = v["s"] * v["sxx"] - v["sx"] ** 2, np.maximum(np.abs(v["s"] * v["sxx"]), v["sx"] ** 2)
        fine = np.abs(det) > 1e-13 * scale
        d0, d1 = np.zeros(len(g)), np.zeros(len(g))
        d0[fine], d1[fine] = solve2(*(v[c][fine] for c in ("s", "sx", "sxx", "sr", "sxr")))
        odd = ~fine  # of all lines that fit the one of least norm, which follows from the values themselves
        if odd.any():
            c0, c1 = v["sr"] + v["b0"] * v["s"] + v["b1"] * v["sx"], v["sxr"] + v["b0"] * v["sx"] + v["b1"] * v["sxx"]
            n0, n1 = solve2(v["s"][odd], v["sx"][odd], v["sxx"][odd], c0[odd], c1[odd])
            d0[odd], d1[odd] = n0 - v["b0"][odd], n1 - v["b1"][odd]
        rss = v["srr"] - 2 * (d0 * v["sr"] + d1 * v["sxr"]) + d0 * d0 * v["s"] + 2 * d0 * d1 * v["sx"] + d1 * d1 * v["sxx"]
        return d0, d1, np.maximum(rss, 0.0)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            d0, d1, rss = corrected(g)
            first = g["status"].isin(["START", "LINE"]).to_numpy()
            n, old0, old1 = g["n"].to_numpy(float), g["b0"].to_numpy(float), g["b1"].to_numpy(float)
            with np.errstate(all="ignore"):
                den = g["s"].to_numpy(float) - n * alpha * (1 + alpha) ** -1.5
                s2 = rss / np.where(den > 0, den, TINY)
            s2 = np.where(first, rss / np.maximum(1, n - 1), np.where(np.isfinite(s2) & (s2 > 0), s2, HUGE))
            # two passes of equal weights, of which the second only corrects the first, are the least squares line
            status = np.where(
                g["status"] == "START", "LINE",
                np.where(g["status"] == "LINE", UNFINISHED, np.where(d0**2 + d1**2 < tolerance, OK, UNFINISHED))
            )
            out = g[names].assign(
                n=g["n"], b0_ols=np.where(first, old0 + d0, g["b0_ols"]), b1_ols=np.where(first, old1 + d1, g["b1_ols"]), b0=old0 + d0,
                b1=old1 + d1, sigma2=s2, status=status, iterations=(g["iterations"] + ~first).astype(np.int32)
            )
            yield out.assign(
                s=g["s"], sx=g["sx"], sxx=g["sxx"], sy=g["sr"] + g["b0"] * g["s"] + g["b1"] * g["sx"],
                sxy=g["sxr"] + g["b0"] * g["sx"] + g["b1"] * g["sxx"], si=g["si"]
            )

    done, n_open = [], state.count()
    for _ in range(max_iterations + 2):
        if not n_open:
            break
        j = bounded_join(rows, state, same_keys(rows, state, names), n_open)
        r = F.col("__y") - F.col("b0") - F.col("b1") * F.col("__x")
        base = F.when((F.col("sigma2") > 0) & (F.col("sigma2") < math.inf), F.col("sigma2")).otherwise(floor)
        w = F.lit(1.0) if alpha == 0 else F.when(F.col("status").isin("START", "LINE"), 1.0).otherwise(
            F.greatest(F.exp(-0.5 * alpha * r * r / base), F.lit(floor))
        )
        j = j.select(*[rows[n] for n in names], "__x", r.alias("__r"), w.alias("__w"))
        x_, r_, w_ = F.col("__x"), F.col("__r"), F.col("__w")
        sums = j.groupBy(*names).agg(
            F.sum(w_).alias("s"), F.sum(w_ * x_).alias("sx"), F.sum(w_ * x_ * x_).alias("sxx"), F.sum(w_ * r_).alias("sr"),
            F.sum(w_ * x_ * r_).alias("sxr"), F.sum(w_ * r_ * r_).alias("srr"), F.sum(1 / w_).alias("si")
        )
        before = state.drop("s", "sx", "sxx", "sy", "sxy", "si")
        both = before.join(sums, same_keys(before, sums, names)).select(
            *[before[c] for c in before.columns], "s", "sx", "sxx", "sr", "sxr", "srr", "si"
        )
        found = materialize(both.mapInPandas(step, f"{key_schema}, {_STATE}"))
        done.append(found.where(F.col("status") == OK))
        state = found.where(F.col("status") != OK)
        n_open = state.count()
    out = state
    for f in done:
        out = out.unionByName(f)
    f = F.col("si") / (F.col("n") * F.col("sigma2"))  # 1 / row variance = weight x f
    status = F.when(F.col("sigma2") == HUGE, FALLBACK).otherwise(F.col("status"))
    return out.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], "n", "b0_ols", "b1_ols", "b0", "b1", "sigma2", status.alias("status"),
        "iterations", (f * F.col("s")).alias("g00"), (f * F.col("sx")).alias("g01"), (f * F.col("sxx")).alias("g11"),
        (f * F.col("sy")).alias("m0"), (f * F.col("sxy")).alias("m1")
    )


def ols(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: Column | None = None) -> DataFrame:
    """Least squares line of each group from five sums: keys, n, b0, b1; null for constant x."""
    w = weight if weight is not None else F.lit(1.0)
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("s"), F.sum(w * F.col(x)).alias("sx"), F.sum(w * F.col(y)).alias("sy"),
        F.sum(w * F.col(x) * F.col(x)).alias("sxx"), F.sum(w * F.col(x) * F.col(y)).alias("sxy")
    )
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    return s.select(
        *keys, "n", F.try_divide(F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy"), det).alias("b0"),
        F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), det).alias("b1")
    )


def alpha_errors(
    df: DataFrame, keys: Sequence[str], x: str, y: str, order: str, alphas: Sequence[float], folds: int = 5,
    max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE, kernel_rows: int = KERNEL_ROWS
) -> DataFrame:
    """For each entity and alpha the sum over the folds of |fit(fold) - fit(rest)|: keys, alpha, error.

    Row i (by ``order``) belongs to fold i mod ``folds``. All alphas, folds and sides of an entity are fitted where its rows
    are, in one pass over the sorted rows; those of entities above ``kernel_rows`` rows by fit_by_sums(). Runs a job.
    """
    if folds < 2 or not alphas:
        raise ValueError("at least two folds and one alpha")
    for a in alphas:
        validate(a, max_iterations, tolerance)
    keys = list(keys)
    rows = df.select(
        *keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.col(order).alias("__o")
    ).where("__x is not null and __y is not null")

    def run(seg: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        xs, ys = seg["__x"].to_numpy(), seg["__y"].to_numpy()
        sizes = np.diff(np.r_[starts, len(seg)])
        entity = np.repeat(np.arange(len(starts)), sizes)
        fold = (np.arange(len(seg)) - starts[entity]) % folds
        out = []
        parts = []
        for f in range(folds):
            for side in (fold == f, fold != f):
                e = entity[side]
                parts.append((xs[side], ys[side], np.flatnonzero(np.r_[True, e[1:] != e[:-1]]) if len(e) else np.zeros(0, int), e))
        for a in alphas:
            error = np.zeros(len(starts))
            for f in range(folds):
                betas = []
                for px, py, at, e in parts[2 * f : 2 * f + 2]:
                    b = np.zeros((len(starts), 2))
                    if len(at):
                        r = fit_segments(px, py, at, a, max_iterations, tolerance)
                        b[e[at], 0], b[e[at], 1] = r["b0"], r["b1"]
                    betas.append(b)
                error += np.sqrt(((betas[0] - betas[1]) ** 2).sum(1))
            out.append(pd.concat([seg[keys].iloc[starts].reset_index(drop=True), pd.DataFrame({"alpha": a, "error": error})], axis=1))
        return pd.concat(out, ignore_index=True)

    small, big, n_big = split_large(rows, keys, kernel_rows)
    out = small.repartition(*keys).sortWithinPartitions(*keys, "__o").mapInPandas(
        by_segments(keys, run), f"{_key_schema(df, keys)}, alpha double, error double"
    )
    if n_big:
        hot = bounded_join(rows, big, same_keys(rows, big, keys), n_big, "left_semi")
        out = out.unionByName(_large_alpha_errors(hot, keys, alphas, folds, max_iterations, tolerance))
    return out


def _large_alpha_errors(
    rows: DataFrame, keys: list[str], alphas: Sequence[float], folds: int, max_iterations: int, tolerance: float
) -> DataFrame:
    """alpha_errors() by sums: each row once for every fold, on the side of the fold or of the rest."""
    own = F.pmod(F.col("__no") - 1, F.lit(folds))
    sides = numbered(rows, keys, ["__o"], "__no").select(
        *keys, "__x", "__y", own.alias("__own"), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("__fold")
    )
    sides = materialize(sides.select(*keys, "__x", "__y", "__fold", (F.col("__own") == F.col("__fold")).alias("__in")))
    out = None
    for a in alphas:
        f = fit_by_sums(sides, [*keys, "__fold", "__in"], "__x", "__y", a, max_iterations, tolerance)
        side = lambda c, inside: F.coalesce(F.max(F.when(F.col("__in") == inside, F.col(c))), F.lit(0.0))
        gap = f.groupBy(*keys, "__fold").agg(
            F.sqrt(
                F.pow(side("b0", True) - side("b0", False), F.lit(2.0)) + F.pow(side("b1", True) - side("b1", False), F.lit(2.0))
            ).alias("__gap")
        )
        one = gap.groupBy(*keys).agg(F.sum("__gap").alias("error")).select(*keys, F.lit(float(a)).alias("alpha"), "error")
        out = one if out is None else out.unionAll(one)
    return out


def best_alpha(errors: DataFrame) -> DataFrame:
    """The alpha of least summed error, the smaller of equal ones; one row, alpha 0 for empty input."""
    s = errors.groupBy("alpha").agg(F.sum("error").alias("error"))
    return s.agg(F.coalesce(F.min_by("alpha", F.struct("error", "alpha")), F.lit(0.0)).alias("alpha"))


def alpha_bias(df: DataFrame, keys: Sequence[str], x: str, y: str, alphas: Sequence[float]) -> DataFrame:
    """Mean distance of the robust from the least squares coefficients for each alpha: alpha, bias_b0, bias_b1."""
    out = None
    for a in alphas:
        f = fit_local(df, keys, x, y, a).where(F.col("n") > 1)
        one = f.agg(
            F.avg(F.abs(F.col("b0") - F.col("b0_ols"))).alias("bias_b0"), F.avg(F.abs(F.col("b1") - F.col("b1_ols"))).alias("bias_b1")
        ).select(F.lit(float(a)).alias("alpha"), "bias_b0", "bias_b1")
        out = one if out is None else out.unionAll(one)
    return out


def group_alpha_bias(members: DataFrame, group: Sequence[str], member: str, alphas: Sequence[float]) -> DataFrame:
    """Mean distance of the robust from the plain mean of the groups for each alpha: alpha, bias_b0, bias_b1."""
    from gridloom.operators.group_model import fit_groups, group_rows

    out = None
    for a in alphas:
        g = group_rows(fit_groups(members, group, member, a), group)
        one = g.agg(
            F.avg(F.abs(F.col("b0_mdpde") - F.col("b0_mean"))).alias("bias_b0"),
            F.avg(F.abs(F.col("b1_mdpde") - F.col("b1_mean"))).alias("bias_b1")
        ).select(F.lit(float(a)).alias("alpha"), "bias_b0", "bias_b1")
        out = one if out is None else out.unionAll(one)
    return out


def fold_of(keys: Sequence[str], order: str, folds: int) -> Column:
    """Round-robin fold of a row within its entity."""
    return F.pmod(F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1, F.lit(folds))
