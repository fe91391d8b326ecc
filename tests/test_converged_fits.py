"""The queries named _converged against fits by hand that iterate to the reference's tolerance."""

from collections import defaultdict

import duckdb
import numpy as np

from gridloom.plans import fit_queries

SMALL = "/root/testdata/sf0.001"


def line(x, y, alpha):
    X = np.stack([np.ones_like(x), x], 1)
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    s2 = ((y - X @ b) ** 2).sum() / (len(x) - 1)
    for step in range(1, 101):
        w = np.maximum(np.exp(-0.5 * alpha * (y - X @ b) ** 2 / s2), 1e-8)
        new = np.linalg.solve(X.T @ (X * w[:, None]), X.T @ (w * y))
        s2 = (w * (y - X @ new) ** 2).sum() / (w.sum() - len(x) * alpha * (1 + alpha) ** -1.5)
        moved, b = ((new - b) ** 2).sum(), new
        if moved < 1e-5:
            break
    return b, s2, step


def middle(beta, alpha):
    mu, spread = np.median(beta, 0), np.eye(2)
    for _ in range(100):
        r = beta - mu
        w = np.maximum(np.exp(-0.5 * alpha * np.einsum("ni,ij,nj->n", r, np.linalg.inv(spread), r)), 0.01 / len(beta))
        new = (beta * w[:, None]).sum(0) / w.sum()
        r = beta - new
        spread = (r * w[:, None]).T @ r / (w.sum() - len(beta) * alpha * (1 + alpha) ** -2)
        moved, mu = ((new - mu) ** 2).sum(), new
        if moved < 1e-5:
            break
    return mu, spread


def grouped(sql):
    out = defaultdict(list)
    for k, *v in duckdb.sql(sql).fetchall():
        out[k].append(v)
    return {k: np.array(v, float) for k, v in out.items()}


def test_lines_and_brands(spark):
    rows = grouped(f"select l_partkey, -0.5 * pow(l_discount * 10, 2), ln(l_extendedprice) from '{SMALL}/lineitem.parquet'")
    want = {k: line(v[:, 0], v[:, 1], 0.1) for k, v in rows.items() if len(v) > 1}
    assert any(step > fit_queries.STEPS for _, _, step in want.values())
    got = {r.l_partkey: r for r in fit_queries.robust_lines_converged(spark, SMALL).collect()}
    assert set(got) == set(want)
    for k, (b, s2, step) in want.items():
        assert abs(got[k].b0 - b[0]) < 1e-5 and abs(got[k].b1 - b[1]) < 1e-5 and abs(got[k].sigma2 - s2) < 1e-5 and got[k].iterations == step
    brands = defaultdict(list)
    for p, g in duckdb.sql(f"select p_partkey, p_brand from '{SMALL}/part.parquet'").fetchall():
        if p in want:
            brands[g].append(want[p][0])
    means = {r.p_brand: r for r in fit_queries.group_estimates_converged(spark, SMALL).collect()}
    assert set(means) == set(brands)
    for g, betas in brands.items():
        if len(betas) > 2:
            mu, spread = middle(np.array(betas), 0.2)
            assert abs(means[g].b0_mdpde - mu[0]) < 1e-4 and abs(means[g].b1_mdpde - mu[1]) < 1e-4 and abs(means[g].l00 - spread[0, 0]) < 1e-4


def test_folds(spark):
    rows = grouped(
        f"select l_suppkey, l_quantity / 10, ln(l_extendedprice) from '{SMALL}/lineitem.parquet' order by l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
    )
    got = {(r.l_suppkey, r.alpha): r.error for r in fit_queries.fold_errors_converged(spark, SMALL).collect()}
    assert len(got) == 11 * len(rows)
    for k, v in rows.items():
        fold = np.arange(len(v)) % 5
        for a in (0.0, 0.3, 1.0):
            want = sum(np.linalg.norm(line(*v[fold == f].T, a)[0] - line(*v[fold != f].T, a)[0]) for f in range(5))
            assert abs(got[k, a] - want) < 1e-4 * max(1, want)
