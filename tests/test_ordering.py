import random

import numpy as np
import pytest

from gridloom.operators import ordering


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, w int, n long")


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_numbers_and_totals(spark, share):
    rng = random.Random(3)
    rows = [
        (
            None if rng.random() < 0.1 else "hot" if rng.random() < share else rng.choice("ab"), rng.choice([None, 1.0, 2.0, rng.random()]),
            rng.choice([None, 1, 2]), i
        ) for i in range(900)
    ]
    df = frame(spark, rows).repartition(5)
    got = sorted(ordering.numbered(df, ["k"], ["v", "n"], "no").collect(), key=lambda r: r.n)
    by_key = {}
    for k, v, _, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        by_key.setdefault(k, []).append(n)
    assert len(got) == 900 and all(by_key[r.k].index(r.n) + 1 == r.no for r in got)
    totals = ordering.running_totals(df, [], ["n"], df["w"], "before").orderBy("n").collect()
    assert [r.before for r in totals] == np.cumsum([0, *[w or 0 for _, _, w, _ in rows]])[:-1].tolist()


@pytest.mark.parametrize("task_rows", [10**6, 10])
def test_percentiles(spark, task_rows):
    rng = random.Random(4)
    rows = [
        (
            rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), 7.0, 7.0, rng.gauss(0, 5), float("inf")]), 1, 1
        ) for _ in range(700)
    ] + [("empty", None, 1, 1), ("one", 3.0, 1, 1)]
    levels = {"low": 0.01, "mid": 0.5, "high": 0.9, "none": 0.0, "top": 1.0}
    got = {r.k: r for r in ordering.percentiles(frame(spark, rows), ["k"], "v", levels, task_rows).collect()}
    assert set(got) == {"a", "b", None, "empty", "one"}
    for k, r in got.items():
        vs = sorted(v for kk, v, *_ in rows if kk == k and v is not None and v == v)
        if not vs:
            assert (r.low, r.mid, r.high, r.none, r.top) == (0, 0, 0, 0, 0)
            continue
        for name in ("low", "mid", "high"):
            at = levels[name] * (len(vs) - 1)
            lo, hi = vs[int(at)], vs[min(len(vs) - 1, -int(-at // 1))]
            want = lo if lo == hi else lo + (hi - lo) * (at - int(at))
            assert r[name] == want or abs(r[name] - want) < 1e-9
        assert r.none == 0 and r.top == vs[-1]
    whole = ordering.percentiles(frame(spark, rows), [], "v", {"mid": 0.5}, task_rows).collect()
    assert len(whole) == 1 and ordering.percentiles(frame(spark, []), ["k"], "v", levels, -1).count() == 0
    assert ordering.percentiles(frame(spark, []), [], "v", {"mid": 0.5}).first().mid == 0.0
