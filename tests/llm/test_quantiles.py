import math
import random

from gridloom.llm import quantiles
from gridloom.operators import skew


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, k string, v double, day int, n long, period string")


def values(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        v = rng.choice(
            [
                rng.gauss(40, 9), rng.random() * 1e-12, rng.expovariate(1) * 10 ** rng.randint(-3, 300), 20.0, -rng.random(), float("inf"),
                -float("inf"), float("nan"), None, 0.0, -0.0, 5e-324, 1.7e308, -1.7e308
            ]
        )
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), v, rng.choice([1, 1, 2, None]), 1, "x"))
    return rows


def test_exact_ranks_and_bounds_of_combined_periods(spark):
    rows = values(spark)
    got = quantiles.quantile_summary(frame(spark, rows), ["k"], "v", "day", 16, (0.99,)).collect()
    groups = {}
    for _, k, v, day, *_ in rows:
        groups.setdefault((k, day), []).append(v)
    clean = {g: sorted(v for v in vs if v is not None and not math.isnan(v)) for g, vs in groups.items()}
    assert {(r.key_value, r.period) for r in got} == set(clean)
    assert len(got) == len(clean) * 18
    for r in got:
        vs = clean[r.key_value, r.period]
        assert r.n == len(vs) and r.rank == max(1, math.ceil(r.p * len(vs))) and r.value_low == r.value_high == vs[r.rank - 1]
        assert r.n_nan == sum(v is not None and math.isnan(v) for v in groups[r.key_value, r.period])
    summary = spark.createDataFrame(got)
    for r in quantiles.combine(summary, (0.1, 0.5, 0.9)).collect():
        every = sorted(v for (k, _), vs in clean.items() if k == r.key_value for v in vs)
        at_or_below = sum(v <= r.value for v in every)
        below = sum(v < r.value for v in every)
        assert at_or_below >= r.p * len(every) and below <= r.p * len(every) + r.rank_error


def test_few_passes_still_bound_the_value(spark):
    rows = [(i, "a", math.sqrt(i), 1, 1, "x") for i in range(5000)]
    for r in quantiles.quantile_summary(frame(spark, rows), ["k"], "v", "day", 4, (), max_passes=1).collect():
        assert r.value_low <= math.sqrt(r.rank - 1) <= r.value_high


def test_no_values(spark):
    assert quantiles.quantile_summary(frame(spark, []), ["k"], "v", "day").count() == 0
    assert quantiles.quantile_summary(frame(spark, [(1, "a", None, 1, 1, "x")]), ["k"], "v", "day").count() == 0
    assert quantiles.combine(quantiles.quantile_summary(frame(spark, []), ["k"], "v", "day")).count() == 0


def test_joins_beyond_the_broadcast_bound_agree(spark, monkeypatch):
    rows = values(spark)[:800]
    a = quantiles.quantile_summary(frame(spark, rows), ["k"], "v", "day", 8, ()).collect()
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert sorted(map(str, quantiles.quantile_summary(frame(spark, rows), ["k"], "v", "day", 8, ()).collect())) == sorted(map(str, a))
