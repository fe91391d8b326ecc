"""The trained alphas against fits one by one, and the studies as they are registered."""

import numpy as np

from gridloom.operators import group_model, robust, tester


def test_trained_alphas():
    g = np.random.default_rng(3)
    x = -0.5 * g.uniform(0, 1, 203) ** 2
    y = 1 + 4 * x + g.normal(0, 0.2, 203)
    y[:20] += 3
    fold, errors = np.arange(203) % 5, []
    for a in tester.LINE_ALPHAS:
        fits = [robust.fit_segments(x[s], y[s], np.array([0]), a) for k in range(5) for s in (fold == k, fold != k)]
        b = np.array([(f["b0"][0], f["b1"][0]) for f in fits])
        errors.append(np.linalg.norm(b[::2] - b[1::2], axis=1).sum())
    assert tester.trained_line_alpha(x, y) == tester.LINE_ALPHAS[int(np.argmin(errors))]
    beta = g.normal((1, 4), (0.1, 0.3), (12, 30, 2))
    beta[:, :4] += 2
    levels = np.linspace(0, 1, 12)
    want = [group_model.group_mean(b, a)[0] for b, a in zip(beta, levels)]
    assert abs(tester.group_means(beta, levels) - want).max() < 1e-9
    g, mixed = np.random.default_rng(1), []
    for _ in range(10):
        mixed.append(beta[0][g.permutation(30)])
    errors = [
        sum(
            np.linalg.norm(group_model.group_mean(m[:15], a)[0] - group_model.group_mean(m[15:], a)[0]) for m in mixed
        ) for a in tester.GROUP_ALPHAS
    ]
    assert tester.trained_group_alpha(beta[0], np.random.default_rng(1)) == tester.GROUP_ALPHAS[int(np.argmin(errors))]


def test_trained_rows(spark):
    line = tester.profile_residuals(spark, tester.scenario_table(spark, "data_outlier").where("scenario in (0, 8)"), 3, 60)
    group = tester.member_residuals(spark, tester.scenario_table(spark, "alpha_member").where("scenario = 9"), 3, 20)
    for df in (line, group):
        assert {r.n for r in tester.summarize(df).where("method = 'trained'").collect()} == {3}
    assert tester.LINE_STUDIES == {"benchmark": (1000, 1000), "data_outlier": (100, 1000), "alpha_data": (100, 1000)}
    assert tester.GROUP_STUDIES == {"member_outlier": (100, 100), "alpha_member": (100, 100)}
