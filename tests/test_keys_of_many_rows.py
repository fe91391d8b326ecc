import math
import random

import pytest

from gridloom.operators import skew, tree_agg


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


def test_tree(spark):
    assert tree_agg.rounds(0) == [1] and tree_agg.rounds(10, 5, 8, 100) == [13, 2, 1] and tree_agg.rounds(10**9, 65_536, 8) == [1908, 239, 30, 4, 1]
    rows = values(spark)
    df = frame(spark, rows).repartition(7)
    flat = {str(r): 1 for r in tree_agg.key_stats(df, ["k", "day"], ["row_id"], 10**9).collect()}
    deep = {str(r): 1 for r in tree_agg.key_stats(df, ["k", "day"], ["row_id"], 16, 2).collect()}
    assert flat == deep
    by_key = {(r.column_name, r.key_value): r for r in tree_agg.key_stats(df, ["k"], ["v"], 50).collect()}
    for k in ("a", "b", None):
        mine = [v for _, kk, v, *_ in rows if kk == k]
        r = by_key["k", k]
        ok = [v for v in mine if v is not None and not math.isnan(v)]
        assert (r.n_rows, r.v_n, r.v_nan, r.v_min, r.v_max) == (
            len(mine), len(ok), sum(v is not None and math.isnan(v) for v in mine), min(ok), max(ok)
        )


def test_heavy_keys(spark):
    rows = [(i, k, 1.0, 1, 1, "x") for i, k in enumerate(["a"] * 8 + ["b"] * 7 + [None] * 85)]
    assert [tuple(r) for r in tree_agg.heavy_keys(tree_agg.key_stats(frame(spark, rows), ["k"], ["v"])).collect()] == [("k", "a")]
    assert tree_agg.heavy_keys(tree_agg.key_stats(frame(spark, []), ["k"], ["v"])).count() == 0


@pytest.mark.parametrize("share", [1 / 64, 1 / 4])
def test_hot_buckets(spark, share):
    df = spark.createDataFrame([("hot" if i % 2 else f"k{i}",) for i in range(4000)], "k string")
    b = skew.bucket_of(df["k"])
    hot = skew.hot_buckets(df, b, share, least=10)
    where = df.where("k = 'hot'").select(b.alias("b")).first().b
    assert hot[where] == -(-2000 // int(4000 * share)) and len(hot) <= 1 / share
