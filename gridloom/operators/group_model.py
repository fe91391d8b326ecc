"""Entities of a group: robust mean and spread of their coefficients, shrinkage towards it, outliers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ordering import numbered, percentiles
from gridloom.operators.robust import FALLBACK, MAX_ITERATIONS, OK, SINGLE, TOLERANCE, UNFINISHED, _key_schema, by_segments, same_keys, split_large, validate
from gridloom.operators.skew import bounded_join
from gridloom.session import materialize

MEMBER_FLOOR = 0.01
#: Members of a group up to which a worker fits it in memory; larger groups are fitted by sums over the cluster.
KERNEL_MEMBERS = 200_000
#: 99 % point of chi-square with two degrees of freedom.
OUTLIER_DISTANCE = -2 * math.log(0.01)

MEMBER_COLUMNS = ["b0", "b1", "g00", "g01", "g11", "m0", "m1"]
FIELDS = (
    "b0_posterior double, b1_posterior double, v00 double, v01 double, v11 double, distance double, is_outlier boolean, n_members int, status string, "
    "b0_mean double, b1_mean double, b0_mdpde double, b1_mdpde double, b0_prior double, b1_prior double, l00 double, l01 double, l11 double"
)


def inverse(a: np.ndarray) -> np.ndarray:
    try:
        if np.linalg.matrix_rank(a) == a.shape[0]:
            return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(a) if np.isfinite(a).all() else np.full_like(a, np.nan)


def inverses(a: np.ndarray) -> np.ndarray:
    """inverse() of each of a stack of matrices."""
    out = np.full_like(a, np.nan)
    known = np.isfinite(a).all((1, 2))
    full = known.copy()
    full[known] = np.linalg.matrix_rank(a[known]) == a.shape[-1] if known.any() else False
    out[full] = np.linalg.inv(a[full])
    for i in np.flatnonzero(known & ~full):
        out[i] = np.linalg.pinv(a[i])
    return out


def posteriors(info: np.ndarray, moment: np.ndarray, own: np.ndarray, spread: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, ...]:
    """Posterior coefficients and covariance of each member, and its parts of the prior's numerator and denominator."""
    k = inverses(own[:, None, None] * spread)
    cov = inverses(info + k)
    post = np.einsum("nij,nj->ni", cov, moment + (k @ np.broadcast_to(mu, moment.shape)[:, :, None])[:, :, 0])
    kc = k @ cov
    return post, cov, np.einsum("nij,nj->ni", kc, moment), kc @ info


def member_weights(beta: np.ndarray, mu: np.ndarray, spread: np.ndarray, alpha: float, floor: float = MEMBER_FLOOR) -> np.ndarray:
    r = beta - mu
    with np.errstate(all="ignore"):
        d = np.einsum("ni,ij,nj->n", r, inverse(spread), r)
        return np.where(np.isfinite(d), np.maximum(np.exp(-0.5 * alpha * d), floor / len(beta)), floor / len(beta))


def member_spread(beta: np.ndarray, mu: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    n, p = beta.shape
    den = w.sum() - n * alpha * (1 + alpha) ** (-1 - p / 2)
    if den <= 0:
        return np.eye(p)
    r = beta - mu
    s = (r * w[:, None]).T @ r / den
    return s if np.isfinite(s).all() else np.eye(p)


def group_mean(
    beta: np.ndarray, alpha: float, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE, floor: float = MEMBER_FLOOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Robust mean, spread matrix, weights and status; starts from the median and the unit matrix."""
    n, p = beta.shape
    if n == 1:
        return beta[0].copy(), np.eye(p), np.ones(1), SINGLE
    mu, spread, w, status = np.median(beta, 0), np.eye(p), np.ones(n), UNFINISHED
    for _ in range(max_iterations):
        w = member_weights(beta, mu, spread, alpha, floor)
        new = (beta * w[:, None]).sum(0) / w.sum()
        spread = member_spread(beta, new, w, alpha)
        moved = ((new - mu) ** 2).sum()
        mu = new
        if moved < tolerance:
            status = OK
            break
    return mu, spread, w, status if np.isfinite(spread).all() else FALLBACK


def shrink(
    beta: np.ndarray, info: np.ndarray, moment: np.ndarray, alpha: float, max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE, floor: float = MEMBER_FLOOR
) -> dict:
    """Group estimate from each member's coefficients and five sums.

    A single member keeps its own coefficients; with two the prior is the robust mean; where a matrix can't be inverted the
    posterior falls back to the member's own coefficients and the prior to the robust mean.
    """
    n, p = beta.shape
    mu, spread, w, status = group_mean(beta, alpha, max_iterations, tolerance, floor)
    out = {
        "mean": beta.mean(0), "mdpde": mu, "prior": mu, "posterior": beta.copy(), "cov": np.zeros((n, p, p)), "spread": spread,
        "status": status
    }
    if n > 1:
        post, cov, num, den = posteriors(info, moment, (n / (1 / w).sum()) / w, spread, mu)
        prior = mu if n == 2 else inverse(den.sum(0)) @ num.sum(0)
        if np.isfinite(post).all() and np.isfinite(prior).all():
            out |= {"prior": prior, "posterior": post, "cov": cov}
        else:
            out["status"] = FALLBACK
    e = out["posterior"] - out["prior"]
    out["distance"] = np.einsum("ni,ij,nj->n", e, inverse(spread), e)
    return out


def fit_groups(
    members: DataFrame, group: Sequence[str], member: str, alpha: float, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE,
    floor: float = MEMBER_FLOOR, alpha_column: str | None = None, kernel_members: int = KERNEL_MEMBERS
) -> DataFrame:
    """Posterior of every member of every group, with the group's estimates: group, member and FIELDS.

    ``members``: group columns, member id, b0, b1, g00, g01, g11, m0, m1 (as fit_local() gives them). What is shuffled and held
    is seven numbers a member, whatever the number of its samples. Groups are sorted and taken many at a time; those above
    ``kernel_members`` members are fitted by sums over the cluster, a scan an iteration. ``alpha_column`` gives each group its
    own alpha (that of its first member). Members with a null coefficient are left out. Runs a job.
    """
    validate(alpha, max_iterations, tolerance, floor)
    group = list(group)
    extra = [alpha_column] if alpha_column else []
    rows = members.select(*group, member, *MEMBER_COLUMNS, *extra).where("b0 is not null and b1 is not null")

    def run(seg: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        v = seg[MEMBER_COLUMNS].to_numpy(float)
        ends = np.r_[starts[1:], len(seg)]
        out = {c.split()[0]: np.empty(len(seg), object if "string" in c else float) for c in FIELDS.split(", ")}
        for a, b in zip(starts, ends):
            x = v[a:b]
            info = np.stack([np.stack([x[:, 2], x[:, 3]], 1), np.stack([x[:, 3], x[:, 4]], 1)], 1)
            al = alpha if not alpha_column else float(seg[alpha_column].iloc[a])
            r = shrink(x[:, :2], info, x[:, 5:7], al, max_iterations, tolerance, floor)
            at = slice(a, b)
            out["b0_posterior"][at], out["b1_posterior"][at] = r["posterior"].T
            out["v00"][at], out["v01"][at], out["v11"][at] = r["cov"][:, 0, 0], r["cov"][:, 0, 1], r["cov"][:, 1, 1]
            out["distance"][at] = r["distance"]
            out["n_members"][at], out["status"][at] = b - a, r["status"]
            for name in ("mean", "mdpde", "prior"):
                out[f"b0_{name}"][at], out[f"b1_{name}"][at] = r[name]
            out["l00"][at], out["l01"][at], out["l11"][at] = r["spread"][0, 0], r["spread"][0, 1], r["spread"][1, 1]
        out["is_outlier"] = out["distance"] > OUTLIER_DISTANCE
        out["n_members"] = out["n_members"].astype(np.int32)
        return pd.concat([seg[[*group, member]], pd.DataFrame(out)[[c.split()[0] for c in FIELDS.split(", ")]]], axis=1)

    small, big, n_big = split_large(rows, group, kernel_members)
    out = small.repartition(*group).sortWithinPartitions(*group, member).mapInPandas(
        by_segments(group, run), f"{_key_schema(members, [*group, member])}, {FIELDS}"
    )
    if n_big:
        hot = bounded_join(rows, big, same_keys(rows, big, group), n_big, "left_semi")
        level = F.min_by(alpha_column, member).cast("double") if alpha_column else F.lit(float(alpha))
        out = out.unionByName(_fit_large_groups(hot, group, member, level, max_iterations, tolerance, floor))
    return out


def large_group_means(
    rows: DataFrame, group: Sequence[str], level: Column, max_iterations: int, tolerance: float, floor: float
) -> DataFrame:
    """group_mean() of groups of any size: group, n, alpha, status, mu0, mu1, s00, s01, s11 (mean and spread), and the mean and
    spread that the last weights were found with (w0, w1, i00, i01, i11: the inverse). ``level`` is an aggregate.

    Every iteration is one scan of the groups still open, with combined sums over the deviations from the mean so far.
    """
    group = list(group)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), level.alias("alpha"))
    for c in ("b0", "b1"):
        m = percentiles(rows, group, c, {f"m_{c}": 0.5})
        sizes = sizes.join(m, same_keys(sizes, m, group)).select(*[sizes[x] for x in sizes.columns], f"m_{c}")
    unit = {"s00": 1.0, "s01": 0.0, "s11": 1.0, "w0": 0.0, "w1": 0.0, "i00": 1.0, "i01": 0.0, "i11": 1.0}
    state = materialize(
        sizes.select(
            *group, "n", "alpha", F.lit(UNFINISHED).alias("status"), F.col("m_b0").alias("mu0"), F.col("m_b1").alias("mu1"),
            *[F.lit(v).alias(c) for c, v in unit.items()]
        )
    )
    schema = f"{_key_schema(state, group)}, n long, alpha double, status string, mu0 double, mu1 double, " + ", ".join(f"{c} double" for c in unit)

    def inverted(batches):
        for g in batches:
            i = inverses(
                np.stack([g[["s00", "s01"]].to_numpy(float), g[["s01", "s11"]].to_numpy(float)], 1)
            ) if len(g) else np.zeros((0, 2, 2))
            yield g.assign(w0=g["mu0"], w1=g["mu1"], i00=i[:, 0, 0], i01=i[:, 0, 1], i11=i[:, 1, 1])

    done, n_open = [], state.count()
    for _ in range(max_iterations):
        if not n_open:
            break
        ready = state.mapInPandas(inverted, schema)
        j = bounded_join(rows, ready, same_keys(rows, ready, group), n_open)
        r0, r1, w = F.col("b0") - F.col("w0"), F.col("b1") - F.col("w1"), large_weight(floor)
        sums = j.select(*[rows[k] for k in group], r0.alias("r0"), r1.alias("r1"), w.alias("w")).groupBy(*group).agg(
            F.sum("w").alias("sw"),
            *[
                F.sum(F.col("w") * F.col(a) * (F.col(b) if b else F.lit(1.0))).alias(f"s_{a}{b}") for a,
                b in (("r0", ""), ("r1", ""), ("r0", "r0"), ("r0", "r1"), ("r1", "r1"))
            ]
        )
        both = ready.join(sums, same_keys(ready, sums, group)).select(
            *[ready[c] for c in ready.columns], *[c for c in sums.columns if c not in group]
        )
        d0, d1 = F.col("s_r0") / F.col("sw"), F.col("s_r1") / F.col("sw")
        den = F.col("sw") - F.col("n") * F.col("alpha") * F.pow(1 + F.col("alpha"), F.lit(-2.0))
        new = {
            c: (
                F.col(f"s_r{c[1]}r{c[2]}") - F.col("sw") * (d0 if c[1] == "0" else d1) * (d0 if c[2] == "0" else d1)
            ) / den for c in ("s00", "s01", "s11")
        }
        usable = (den > 0) & F.coalesce(F.abs(new["s00"] + new["s11"] + new["s01"]) < float("inf"), F.lit(False))
        found = both.select(
            *group, "n", "alpha", F.when(d0 * d0 + d1 * d1 < tolerance, OK).otherwise(UNFINISHED).alias("status"),
            (F.col("w0") + d0).alias("mu0"), (F.col("w1") + d1).alias("mu1"),
            *[F.when(usable, v).otherwise(F.lit(0.0 if c == "s01" else 1.0)).alias(c) for c, v in new.items()], "w0", "w1", "i00", "i01",
            "i11"
        )
        found = materialize(found)
        done.append(found.where(F.col("status") == OK))
        state = found.where(F.col("status") != OK)
        n_open = state.count()
    out = state
    for f in done:
        out = out.unionByName(f)
    return out


def large_weight(floor: float) -> Column:
    """A member's weight under w0, w1 and the inverse spread i00, i01, i11 of its group."""
    r0, r1 = F.col("b0") - F.col("w0"), F.col("b1") - F.col("w1")
    d = r0 * r0 * F.col("i00") + 2 * r0 * r1 * F.col("i01") + r1 * r1 * F.col("i11")
    least = F.lit(float(floor)) / F.col("n")
    return F.coalesce(F.when(F.abs(d) < float("inf"), F.greatest(F.exp(-0.5 * F.col("alpha") * d), least)), least)


def _fit_large_groups(
    rows: DataFrame, group: list[str], member: str, level: Column, max_iterations: int, tolerance: float, floor: float
) -> DataFrame:
    """fit_groups() by sums: means, then the members' posteriors with their parts of the prior, then the distances."""
    rows = materialize(rows)
    state = materialize(large_group_means(rows, group, level, max_iterations, tolerance, floor))
    n_groups = state.count()
    j = bounded_join(rows, state, same_keys(rows, state, group), n_groups).select(
        *[rows[c] for c in [*group, member, *MEMBER_COLUMNS]], *[c for c in state.columns if c not in group]
    ).withColumn("w", large_weight(floor))
    totals = materialize(
        j.groupBy(*group).agg(F.sum(1 / F.col("w")).alias("si"), F.avg("b0").alias("b0_mean"), F.avg("b1").alias("b1_mean"))
    )
    k = bounded_join(j, totals, same_keys(j, totals, group), n_groups).select(*[j[c] for c in j.columns], "si", "b0_mean", "b1_mean")
    parts = ["p0", "p1", "v00", "v01", "v11", "u0", "u1", "d00", "d01", "d10", "d11"]
    keep = [*group, member, "b0", "b1", "n", "status", "b0_mean", "b1_mean", "mu0", "mu1", "s00", "s01", "s11"]

    def run(batches):
        for g in batches:
            v = g[["b0", "b1", "g00", "g01", "g11", "m0", "m1"]].to_numpy(float)
            info = np.stack([np.stack([v[:, 2], v[:, 3]], 1), np.stack([v[:, 3], v[:, 4]], 1)], 1)
            spread = np.stack([g[["s00", "s01"]].to_numpy(float), g[["s01", "s11"]].to_numpy(float)], 1)
            own = (g["n"] / g["si"] / g["w"]).to_numpy(float)
            post, cov, num, den = posteriors(info, v[:, 5:7], own, spread, g[["mu0", "mu1"]].to_numpy(float))
            yield pd.concat(
                [
                    g[keep].reset_index(drop=True),
                    pd.DataFrame(np.column_stack([post, cov[:, 0, 0], cov[:, 0, 1], cov[:, 1, 1], num, den.reshape(-1, 4)]), columns=parts)
                ],
                axis=1
            )

    schema = ", ".join(f"`{c}` {k.schema[c].dataType.simpleString()}" for c in keep) + ", " + ", ".join(f"{c} double" for c in parts)
    mapped = materialize(k.mapInPandas(run, schema))
    odd = F.count_if(~(F.abs(F.col("p0") + F.col("p1")) < float("inf")) | F.isnan(F.col("p0") + F.col("p1")))
    sums = mapped.groupBy(*group).agg(
        *[F.sum(c).alias(f"t_{c}") for c in ("u0", "u1", "d00", "d01", "d10", "d11")], odd.alias("odd"), F.first("n").alias("n"),
        F.first("status").alias("status"), *[F.first(c).alias(c) for c in ("mu0", "mu1", "s00", "s01", "s11")]
    )
    fields = [*group, "prior0", "prior1", "fine", "end_status", "j00", "j01", "j11"]

    def close(batches):
        for g in batches:
            out = g[group].copy()
            den = g[["t_d00", "t_d01", "t_d10", "t_d11"]].to_numpy(float).reshape(-1, 2, 2)
            prior = np.einsum("nij,nj->ni", inverses(den), g[["t_u0", "t_u1"]].to_numpy(float)) if len(g) else np.zeros((0, 2))
            prior = np.where((g["n"] == 2).to_numpy()[:, None], g[["mu0", "mu1"]].to_numpy(float), prior)
            fine = np.isfinite(prior).all(1) & (g["odd"] == 0).to_numpy()
            i = inverses(
                np.stack([g[["s00", "s01"]].to_numpy(float), g[["s01", "s11"]].to_numpy(float)], 1)
            ) if len(g) else np.zeros((0, 2, 2))
            prior = np.where(fine[:, None], prior, g[["mu0", "mu1"]].to_numpy(float))
            yield out.assign(
                prior0=prior[:, 0], prior1=prior[:, 1], fine=fine, end_status=np.where(fine, g["status"], FALLBACK), j00=i[:, 0, 0],
                j01=i[:, 0, 1], j11=i[:, 1, 1]
            )[fields]

    ends = materialize(
        sums.mapInPandas(
            close,
            f"{_key_schema(rows, group)}, prior0 double, prior1 double, fine boolean, end_status string, j00 double, j01 double, j11 double"
        )
    )
    m = bounded_join(mapped, ends, same_keys(mapped, ends, group), n_groups)
    pick = lambda a, b: F.when(F.col("fine"), F.col(a)).otherwise(F.col(b) if isinstance(b, str) else F.lit(b))
    e0, e1 = pick("p0", "b0") - F.col("prior0"), pick("p1", "b1") - F.col("prior1")
    distance = e0 * e0 * F.col("j00") + 2 * e0 * e1 * F.col("j01") + e1 * e1 * F.col("j11")
    return m.select(
        *[mapped[c] for c in [*group, member]], pick("p0", "b0").alias("b0_posterior"), pick("p1", "b1").alias("b1_posterior"),
        *[pick(c, 0.0).alias(c) for c in ("v00", "v01", "v11")], distance.alias("distance"),
        F.coalesce(distance > OUTLIER_DISTANCE, F.lit(False)).alias("is_outlier"), F.col("n").cast("int").alias("n_members"),
        F.col("end_status").alias("status"), "b0_mean", "b1_mean", F.col("mu0").alias("b0_mdpde"), F.col("mu1").alias("b1_mdpde"),
        F.col("prior0").alias("b0_prior"), F.col("prior1").alias("b1_prior"), F.col("s00").alias("l00"), F.col("s01").alias("l01"),
        F.col("s11").alias("l11"),
    )


def group_rows(posterior: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row a group of fit_groups()' result, with the number of members and outliers."""
    keep = ["status", "b0_mean", "b1_mean", "b0_mdpde", "b1_mdpde", "b0_prior", "b1_prior", "l00", "l01", "l11"]
    return posterior.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_members"), F.count_if("is_outlier").alias("n_outliers"), *[F.first(c).alias(c) for c in keep]
    )


def half_split_errors(
    members: DataFrame, group: Sequence[str], member: str, alphas: Sequence[float], repeats: int = 10, seed: int = 0,
    max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE, kernel_members: int = KERNEL_MEMBERS
) -> DataFrame:
    """For each group and alpha the sum over ``repeats`` random halvings of |mean(half) - mean(other half)|: group, alpha, error.

    Repeat i orders the members by a hash of (seed, i, member), so the result doesn't depend on partitions. Groups above
    ``kernel_members`` members are halved and averaged over the cluster. Runs a job.
    """
    group = list(group)
    order = F.xxhash64(F.lit(seed), F.col("__i"), F.col(member))
    rows = members.select(*group, member, "b0", "b1").where("b0 is not null and b1 is not null").withColumn(
        "__i", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    ).withColumn("__o", order)
    keys = [*group, "__i"]

    def run(seg: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        beta, ends, out = seg[["b0", "b1"]].to_numpy(float), np.r_[starts[1:], len(seg)], []
        for a, b in zip(starts, ends):
            half = a + (b - a) // 2
            for al in alphas:
                e = 0.0
                if half > a:
                    e = float(
                        np.linalg.norm(
                            group_mean(
                                beta[a:half], al, max_iterations, tolerance
                            )[0] - group_mean(beta[half:b], al, max_iterations, tolerance)[0]
                        )
                    )
                out.append((*seg[group].iloc[a], al, e))
        return pd.DataFrame(out, columns=[*group, "alpha", "error"])

    small, big, n_big = split_large(rows, keys, kernel_members)
    halves = small.repartition(*keys).sortWithinPartitions(*keys, "__o", member).mapInPandas(
        by_segments(keys, run), f"{_key_schema(members, group)}, alpha double, error double"
    )
    if n_big:
        hot = bounded_join(rows, big, same_keys(rows, big, keys), n_big)
        hot = hot.select(*[rows[c] for c in rows.columns], "__n")
        placed = numbered(hot, keys, ["__o", member], "__no").withColumn("__first", F.col("__no") <= F.floor(F.col("__n") / 2))
        each = materialize(
            placed.select(*keys, "__first", "b0", "b1", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("__alpha"))
        )
        m = large_group_means(each, [*keys, "__alpha", "__first"], F.first("__alpha"), max_iterations, tolerance, MEMBER_FLOOR)
        side = lambda c, first: F.max(F.when(F.col("__first") == first, F.col(c)))
        gap = F.sqrt(F.pow(side("mu0", True) - side("mu0", False), F.lit(2.0)) + F.pow(side("mu1", True) - side("mu1", False), F.lit(2.0)))
        halves = halves.unionAll(
            m.groupBy(*keys, "__alpha").agg(gap.alias("error")).select(*group, F.col("__alpha").alias("alpha"), "error")
        )
    return halves.groupBy(*group, "alpha").agg(F.sum("error").alias("error"))
