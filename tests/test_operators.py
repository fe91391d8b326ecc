"""Closed-form expectations and edge cases of the relational operators and estimators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import gauss, keys, strings
from gridloom.operators import grid, group_model, lookup, robust, samplers, select, spatial, stats


def values(spark, vs):
    return spark.createDataFrame([(float(v),) for v in vs], "v double")


@pytest.mark.parametrize(
    ("vs", "p", "want"),
    [
        ([1, 2, 3, 4], 0, 0), ([1, 2, 3, 4], 0.5, 2.5), ([1, 2, 3, 4], 1, 4), ([3, 1, 4, 2], 0.25, 1.75), ([1, 2, 3], -0.1, 0),
        ([1, 2, 3], 1.5, 3), ([], 0.5, 0), ([1, 2, 2, 3], 0.25, 1.75), ([1, 2, 2, 3], 0.75, 2.25)
    ]
)
def test_percentile(spark, vs, p, want):
    assert values(spark, vs).agg(stats.percentile(F.col("v"), p).alias("x")).first().x == want


def test_empty_and_single(spark):
    c = F.col("v")
    r = values(spark, []).agg(
        stats.mean(c).alias("m"), stats.sd(c).alias("s"), stats.median(c).alias("d"), stats.minimum(c).alias("lo"),
        stats.value_range(c)[1].alias("hi")
    ).first()
    assert (r.m, r.s, r.d, r.hi) == (0, 0, 0, 0) and math.isnan(r.lo)
    assert values(spark, [7]).agg(stats.sd(c).alias("s")).first().s == 0
    one = spark.createDataFrame([("a", 0.1, 2.0), ("a", 0.2, 2.0)], "k string, d double, v double")
    assert stats.q_score(one, ["k"], "d", "v").first().q_score == 0.0
    assert stats.normalize_by_sd(one, "v", ["k"]).first().v == 2.0 and stats.normalize_by_sd(one, "v").count() == 2
    assert one.where("false").agg(stats.moments(F.col("d"), F.col("v"))[0].alias("m")).first().m is None


@pytest.mark.parametrize(("vs", "ranks"), [([3, 1, 2], [3, 1, 2]), ([2, 3, 3, 4], [1, 2, 2, 4]), ([5], [1])])
def test_rank(spark, vs, ranks):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(vs)] + [(None, 0, None)], "k int, m int, v double")
    got = {r.m: r["rank"] for r in lookup.rank_of_values(df, ["k"], "m", range(len(vs)), "v").where("k = 1").collect()}
    assert [got[i] for i in range(len(vs))] == ranks


def line(spark, xs):
    return spark.createDataFrame(
        [(i, None if x is None else float(x), 0.0, 0.0) for i, x in enumerate(xs)], "id long, x double, y double, z double"
    )


def test_range_includes_its_boundary(spark):
    p = line(spark, [0, 1, 2, 5, None])
    q = p.where("id = 0")
    assert spatial.range_join(q, p, "xyz", 1.0).count() == 2 and spatial.range_join(q, p, "xyz", 2.0).count() == 3
    n = {r.id: r.n_neighbours for r in spatial.neighbour_counts(p, "id", "xyz", 1.0).collect()}
    assert n == {0: 2, 1: 3, 2: 2, 3: 1, 4: 0}
    with pytest.raises(ValueError):
        spatial.range_join(q, p, "xyz", 0.0)


@pytest.mark.parametrize("rings", [6, 0])
def test_nearest(spark, rings):
    p = line(spark, [0, 1, 2, 3, 4, 1000, None]).withColumnRenamed("id", "p")
    q = line(spark, [0, None, 1e6])
    got = {}
    for r in spatial.nearest(q, p, "id", "p", "xyz", 3, 1.0, rings).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.p
    assert got == {0: {1: 0, 2: 1, 3: 2}, 2: {1: 5, 2: 4, 3: 3}}
    assert spatial.nearest(q.where("id = 0"), p, "id", "p", "xyz", 50, 1.0, rings).count() == 6


@pytest.mark.parametrize(("rings", "k"), [(0, 1), (0, 7), (1, 7), (0, 400)])
def test_descent_finds_the_nearest(spark, rings, k):
    rng = np.random.default_rng(12)
    place = np.r_[rng.normal(0, 1, (120, 2)), rng.normal((5e4, -3e3), 0.01, (120, 2)), np.zeros((30, 2)), rng.uniform(-1e6, 1e6, (10, 2))]
    ask = np.r_[rng.normal(0, 3, (20, 2)), rng.uniform(-2e6, 2e6, (20, 2)), [(5e4, -3e3)], np.zeros((1, 2))]
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(place)], "p long, x double, y double")
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(ask)], "q long, x double, y double")
    got = {}
    for r in spatial.nearest(q, p, "q", "p", "xy", k, 0.5, rings).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.distance, r.p)
    d = np.sqrt(((ask[:, None] - place[None]) ** 2).sum(2))
    for i in range(len(ask)):
        order = np.lexsort((np.arange(len(place)), d[i]))[:k]
        assert [got[i][n + 1][1] for n in range(len(order))] == order.tolist() and len(got[i]) == len(order)
    assert spatial.nearest(q, p.limit(0), "q", "p", "xy", k, 0.5, rings).count() == 0


def test_range_join_broadcasts_counted_sides(spark, monkeypatch):
    a = line(spark, [0, 1, 2, 5, None]).withColumn("k", F.lit("a"))
    both = [sorted((r.l.id, r.r.id) for r in spatial.range_join(a, a, "xyz", 1.0, ["k"], right_rows=n).collect()) for n in (None, 5)]
    assert both[0] == both[1] and len(both[0]) == 8


def test_edges_and_adjacency(spark):
    a = spark.createDataFrame(
        [("m", 1, 0.0, 0.0, 0.0), ("m", 2, 1.0, 0.0, 0.0)], "key_tag string, serial_id int, x double, y double, z double"
    )
    b = spark.createDataFrame(
        [("m", 1, 2), ("m", 1, 1), ("m", 1, None), ("m", 1, 9)], "key_tag string, atom_serial_id_1 int, atom_serial_id_2 int"
    )
    g = {r.atom_serial_id_2: r for r in spatial.edge_geometry(b, a, ["key_tag"], "xyz").collect()}
    assert (g[2].mid_x, g[2].vec_x, g[2].unit_x, g[2].length) == (0.5, 1.0, 1.0, 1.0) and g[1].unit_x == 0.0 and len(g) == 2
    assert spatial.adjacency(b, ["key_tag"]).count() == 5


def test_interpolation_at_nodes_edges_and_outside(spark):
    g = grid.Grid((2, 2, 2))
    v = spark.createDataFrame([(i, float(i + 1)) for i in range(8)], "gid long, value double")
    p = spark.createDataFrame(
        [(0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0), (2, 0.5, 0.0, 0.0), (3, 9.0, 9.0, 9.0), (4, None, 0.0, 0.0)],
        "id long, x double, y double, z double"
    )
    got = {r.id: r.value for r in grid.interpolate(p, v, g, "id").collect()}
    assert abs(got[0] - 1) < 1e-12 and abs(got[1] - 8) < 1e-12 and abs(got[2] - 1.5) < 1e-12 and got[3] is not None and got[4] is None
    assert grid.interpolate(p, v.limit(0), g, "id").where("value <> 0").count() == 0


def test_scatter_and_grid(spark):
    g = grid.Grid.around((0.2, 0, 0), (1.2, 0, 0), 0.5, 1.0)
    assert g.size == (6, 4, 4) and g.origin == (-1.0, -1.0, -1.0)
    p = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    f = {r.gid: r.value for r in grid.scatter_add(p, g, 0.5, F.lit(1.0)).collect()}
    assert len(f) == g.n and sum(f.values()) == 7
    far = spark.createDataFrame([(99.0, 0.0, 0.0)], "x double, y double, z double")
    assert grid.stencil(far, g, 1.0).count() == 0
    with pytest.raises(ValueError):
        grid.reorder_axes(p.withColumn("gid", F.lit(0)), "gid", (1, 1, 1), (1, 1, 2))


def test_intervals(spark):
    r = spark.createDataFrame(
        [
            (1, "A", 1, 10, "SHEET", 2), (2, "A", 5, 500, "HELX", 1), (3, "A", 9, 3, "HELX", 0), (4, "A", None, 3, "HELX", 0),
            (5, "B", 1, 2, "X", 1)
        ],
        "range_id int, chain string, low int, high int, label string, priority int"
    )
    a = spark.createDataFrame(
        [(i, c, s) for i, (c, s) in enumerate([("A", 1), ("A", 5), ("A", 500), ("A", 501), ("A", None), ("B", 5), (None, 1)])],
        "id int, chain string, seq int"
    )
    got = {x.id: x.label for x in lookup.label_intervals(a, r, ["chain"], "seq", default="FREE").collect()}
    assert got == {0: "SHEET", 1: "HELX", 2: "HELX", 3: "FREE", 4: "FREE", 5: "FREE", 6: "FREE"}


def test_selection(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), (None, 1)], "c string, e int")
    assert df.where(select.pick_veto({}, {})).count() == 4
    assert [
        tuple(r) for r in df.where(select.pick_veto({"c": select.parse_names(" A , B ,")}, {"c": ["B"], "e": [2]})).collect()
    ] == [("A", 1)]
    assert df.where(select.pick_veto({}, {"c": ["A"]})).count() == 2
    none = spark.createDataFrame([], "entity_id string, chain_ordinal int, chain_id string")
    atoms = df.withColumnRenamed("c", "chain_id")
    assert select.first_chains(atoms, none).count() == 4
    assert select.has_any(df, F.col("c") == "A") and not select.has_any(df, F.col("c") == "Z")


def test_keys(spark):
    one = spark.range(1)
    k = keys.STRUCTURE_ATOM.pack(F.lit(255), F.lit(7), F.lit(65535))
    r = one.select(k.alias("k"), keys.STRUCTURE_ATOM.label(k).alias("s"), *keys.STRUCTURE_ATOM.unpack(k)).first()
    assert (r.k, r.s, r.structure, r.component_key, r.atom_key) == (255 + (7 << 8) + (65535 << 16), "<255, 7, 65535>", 255, 7, 65535)
    ids = spark.createDataFrame([("b", 3), ("a", 3), ("k", 1), ("b", 0), (None, 0)], "id string, o int")
    known = spark.createDataFrame([("k", 5)], "id string, code int")
    got = {x.id: x.code for x in keys.encode_ids(ids, "id", "o", known, 30, limit=30).collect()}
    assert got == {"k": 5, "b": 30, "a": None}
    assert one.select(keys.reversed_bond_id(F.lit("C_N")).alias("b")).first().b == "N_C"


def test_strings(spark):
    one = spark.range(1)
    r = one.select(
        strings.int_prefix(F.lit("10A")).alias("a"), strings.float_prefix(F.lit(" 1.5e1x")).alias("b"),
        strings.missing_to_null(F.lit("?")).alias("c"), strings.split_list(F.lit(" a,,b ")).alias("d"),
        strings.number_list(F.lit("1, 2.5")).alias("e"), strings.number_list(F.lit("1,x")).alias("f"),
        strings.strip_carriage_return(F.lit("x\r")).alias("g"), strings.pad_right(F.lit("abc"), 2).alias("h"),
        strings.char_at(F.lit("abc"), 2).alias("i"), strings.char_at(F.lit("abc"), 3).alias("j"),
        strings.extension(F.lit("/a.b/C.MRC")).alias("k"), strings.file_name(F.lit("/a/b.c")).alias("l"),
        strings.directory(F.lit("/a/b.c")).alias("m"), strings.erase(F.lit("a\"b"), '"').alias("n")
    ).first()
    assert list(r) == [10, 15.0, None, ["a", "b"], [1.0, 2.5], None, "x", "abc", "c", None, ".mrc", "b.c", "/a/", "ab"]


def test_gauss(spark):
    one = spark.range(1)
    a, w = gauss.gauss_from_beta(F.lit(1.2), F.lit(3.4))
    zero = gauss.gauss_from_beta(F.lit(0.5), F.lit(-1.0))
    s = gauss.sigma_from_beta(F.lit(0.5), F.lit(2.0), F.lit(0.1), F.lit(0.2), F.lit(0.05))
    b = gauss.beta_from_gauss(a, w)
    r = one.select(
        a.alias("a"), w.alias("w"), zero[0].alias("z"), zero[1].alias("y"), s[0].alias("s"), s[1].alias("t"), b[0].alias("b0"),
        b[1].alias("b1"), gauss.intensity(F.lit(1.0), F.lit(0.0)).alias("i")
    ).first()
    assert abs(r.a - math.exp(1.2) * (2 * math.pi / 3.4) ** 1.5) < 1e-9 and abs(r.w - 3.4**-0.5) < 1e-12 and (r.z, r.y, r.i) == (0, 0, 0)
    assert abs(
        r.s - math.sqrt((2 * math.pi) ** 3 * math.e * 2**-5 * (4 * 0.1 + 2.25 * 0.2 - 6 * 0.05))
    ) < 1e-9 and abs(r.t - math.sqrt(0.25 / 8 * 0.2)) < 1e-12
    assert abs(r.b0 - 1.2) < 1e-9 and abs(r.b1 - 3.4) < 1e-9
    e = spark.createDataFrame([(1,), (2,)], "k int")
    rows = spark.createDataFrame([(1, 0.5, 2.0), (1, 0.5, -2.0), (1, 3.0, 2.0)], "k int, d double, v double")
    got = {x.k: (x.x0, x.x1, x.y) for x in gauss.linearize_entities(e, rows, "k", "d", "v", 0.0, 1.0).collect()}
    assert got == {1: (1.0, -0.125, math.log(2)), 2: (0.0, 0.0, 0.0)}


def test_kernel_agrees_with_sums_and_keeps_floors(spark):
    rng = np.random.default_rng(4)
    rows = [
        (
            k, float(x), float(1 + 2 * x + rng.normal(0, 0.1) + (5 if rng.random() < 0.1 else 0))
        ) for k in ("a", "b", None) for x in rng.uniform(0, 1, 200)
    ]
    df = spark.createDataFrame(rows + [("a", None, 1.0), ("a", float("nan"), 1.0)], "k string, x double, y double")
    a = {r.k: r for r in robust.fit_local(df, ["k"], "x", "y", 0.5).collect()}
    b = {r.k: r for r in robust.fit_local(df, ["k"], "x", "y", 0.5, kernel_rows=10).collect()}
    assert set(a) == set(b) == {"a", "b", None}
    for k in a:
        assert abs(a[k].b1 - 2) < 0.2 and a[k].n == 200
        for c in ("b0", "b1", "sigma2", "b0_ols", "g00", "g11", "m1"):
            assert math.isclose(a[k][c], b[k][c], rel_tol=1e-6), (k, c)
        assert a[k].iterations == b[k].iterations and a[k].status == b[k].status == "SUCCESS"
    c = {r.k: r for r in robust.fit_local(df, ["k"], "x", "y", 0.0, kernel_rows=10).collect()}
    d = {r.k: r for r in robust.fit_local(df, ["k"], "x", "y", 0.0).collect()}
    assert all(math.isclose(c[k][v], d[k][v], rel_tol=1e-9) for k in c for v in ("b0", "b1", "sigma2", "g00"))
    flat = robust.fit_segments(np.array([1.0, 1.0, 1.0]), np.array([1.0, 2.0, 3.0]), np.array([0]), 0.0)
    assert abs(flat["b0"][0] + flat["b1"][0] - 2) < 1e-9


def test_sums_keep_the_digits_of_nearly_exact_fits(spark):
    rng = np.random.default_rng(9)
    rows = [
        ("far", float(x), float(1e7 + 3e5 * x + 1e-4 * rng.normal())) for x in rng.uniform(100, 101, 400)
    ] + [("flat", 2.0, float(y)) for y in rng.normal(5, 1, 300)] + [("exact", float(i), 2.0 + 3.0 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for alpha in (0.0, 0.3):
        a, b = ({r.k: r for r in robust.fit_local(df, ["k"], "x", "y", alpha, kernel_rows=n).collect()} for n in (10**6, 10))
        for k in ("far", "flat"):
            assert a[k].status == b[k].status
            for c, tol in (("b0", 1e-7), ("b1", 1e-7), ("sigma2", 1e-3)):
                assert math.isclose(a[k][c], b[k][c], rel_tol=tol, abs_tol=1e-12), (alpha, k, c, a[k][c], b[k][c])
        assert abs(b["far"].sigma2 - 1e-8) < 5e-9 and abs(b["exact"].b0 - 2) < 1e-9 and abs(b["exact"].b1 - 3) < 1e-9


def test_large_entities_train_alpha_by_sums(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(
        [(k, i, float(x), float(1 + x + rng.standard_t(2))) for k in ("a", None) for i, x in enumerate(rng.uniform(0, 3, 60))],
        "k string, o int, x double, y double"
    )
    a, b = (
        {
            (r.k, r.alpha): r.error for r in robust.alpha_errors(df, ["k"], "x", "y", "o", [0.0, 0.4], 3, kernel_rows=n).collect()
        } for n in (1000, 10)
    )
    assert set(a) == set(b) and all(math.isclose(a[x], b[x], rel_tol=1e-5) for x in a)


@pytest.mark.parametrize("alpha", [0.0, 0.2, None])
def test_large_groups_agree_with_small_ones(spark, alpha):
    rng = np.random.default_rng(6)
    rows = []
    for g in ("a", "b", None):
        for i in range(60):
            b = rng.normal((1, 4), (0.2, 0.5)) + (3 if i % 15 == 0 else 0)
            m = rng.normal(0, 1, (5, 2))
            info = m.T @ m + np.eye(2)
            rows.append(
                (
                    g, i, *map(float, b), float(info[0, 0]), float(info[0, 1]), float(info[1, 1]), *map(float, info @ b),
                    0.1 if g == "a" else 0.3
                )
            )
    df = spark.createDataFrame(
        rows, "g string, id int, b0 double, b1 double, g00 double, g01 double, g11 double, m0 double, m1 double, own double"
    )
    ask = {"alpha": 0.2 if alpha is None else alpha, "alpha_column": "own" if alpha is None else None}
    x, y = ({(r.g, r.id): r for r in group_model.fit_groups(df, ["g"], "id", **ask, kernel_members=n).collect()} for n in (1000, 10))
    assert set(x) == set(y) and len(x) == 180
    for k in x:
        for c in x[k].__fields__:
            u, v = x[k][c], y[k][c]
            assert math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-9) if isinstance(u, float) else u == v, (k, c, u, v)
    halves = [
        {
            (r.g, r.alpha): r.error for r in group_model.half_split_errors(df, ["g"], "id", [0.0, 0.3], 3, kernel_members=n).collect()
        } for n in (1000, 10)
    ]
    assert set(halves[0]) == set(halves[1]) and all(math.isclose(halves[0][k], halves[1][k], rel_tol=1e-6) for k in halves[0])


def test_groups(spark):
    eye = np.stack([np.eye(2)] * 3)
    one = group_model.shrink(np.array([[1.0, 2.0]]), eye[:1], np.array([[1.0, 2.0]]), 0.2)
    assert one["status"] == "SINGLE_MEMBER" and (one["prior"] == [1, 2]).all() and (one["posterior"][0] == [1, 2]).all() and not one["cov"].any()
    two = group_model.shrink(np.array([[1.0, 2.0], [3.0, 1.0]]), eye[:2], np.array([[1.0, 2.0], [3.0, 1.0]]), 0.0)
    assert np.allclose(two["prior"], two["mdpde"]) and np.allclose(two["mean"], [2, 1.5])
    w = group_model.member_weights(np.array([[0.0, 0], [10, 10]]), np.zeros(2), np.eye(2), 1.0, 0.4)
    assert np.allclose(w, [1.0, 0.2])
    assert [d > group_model.OUTLIER_DISTANCE for d in (1.0, 12.0, 100.0)] == [False, True, True]
    same = spark.createDataFrame([("g", i, 1.0, 2.0) for i in range(6)], "g string, id int, b0 double, b1 double")
    assert all(r.error == 0 for r in group_model.half_split_errors(same, ["g"], "id", [0.0, 0.5, 1.0], 4).collect())
    df = spark.createDataFrame(
        [("g", i, float(i), 1.0, 2.0, 0.1, 2.0, 1.0, 1.0) for i in range(5)] + [
            ("s", 9, 1.0, 2.0, 1.0, 0.0, 1.0, 1.0, 2.0), ("s", 8, None, 2.0, 1.0, 0.0, 1.0, 1.0, 2.0)
        ],
        "g string, id int, b0 double, b1 double, g00 double, g01 double, g11 double, m0 double, m1 double"
    )
    out = group_model.group_rows(group_model.fit_groups(df, ["g"], "id", 0.2), ["g"]).collect()
    assert {r.g: r.n_members for r in out} == {"g": 5, "s": 1}
    assert group_model.fit_groups(df.limit(0), ["g"], "id", 0.2).count() == 0


def test_samplers(spark):
    p = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0), (2, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)],
        "id int, x double, y double, z double, vx double, vy double, vz double"
    )
    s = samplers.plane(p, 3, 2.0).where("id = 1").collect()
    assert all(abs(r.pz) < 1e-12 for r in s) and sorted(round(r.distance, 6) for r in s) == sorted(
        [0.0] + [1.0] * 4 + [round(math.sqrt(2), 6)] * 4
    )
    a = samplers.sphere(p, "id", 5, 0.5, 1.0, 1).collect()
    assert sorted(map(tuple, a)) == sorted(
        map(tuple, samplers.sphere(p.repartition(3), "id", 5, 0.5, 1.0, 1).collect())
    ) != sorted(map(tuple, samplers.sphere(p, "id", 5, 0.5, 1.0, 2).collect()))
    with pytest.raises(ValueError):
        samplers.sphere(p, "id", 5, 2.0, 1.0)
    with pytest.raises(ValueError):
        samplers.cylinder(p, "id", 0, 0.0, 1.0, 1.0)


def test_mean_shift_to_the_nearest(spark):
    g = np.random.default_rng(5)
    place, value = np.r_[g.normal(0, 1, (60, 3)), g.normal(40, 8, (12, 3))], g.uniform(-0.2, 1, 72)  # the sparse ones are far apart
    df = spark.createDataFrame(
        [(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(place, value))],
        "gid long, x double, y double, z double, value double"
    )
    for k in (6, 100):
        at = place.copy()
        for _ in range(3):
            near = np.argsort(((at[:, None] - place[None]) ** 2).sum(2), 1, kind="stable")[:, :k]
            w = np.maximum(value[near], 0) ** 2
            at = (w[:, :, None] * place[near]).sum(1) / w.sum(1)[:, None]
        got = {r.gid: (r.x, r.y, r.z) for r in spatial.mean_shift_nearest(df, df, "gid", "xyz", "value", 0.5, k, 2.0, 3).collect()}
        assert len(got) == 72 and max(abs(np.array(got[i]) - at[i]).max() for i in got) < 1e-9
    assert spatial.mean_shift_nearest(df, df.limit(0), "gid", "xyz", "value", 0.5).count() == 72


def test_whole_texts_in_upper_case(spark, data):
    import hashlib

    from gridloom.plans import data_queries

    want = {
        r.doc_id: hashlib.md5(r.text.upper().encode()).hexdigest() for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").collect()
    }
    assert {r.doc_id: r.hash for r in data_queries.upper_texts(spark, data).collect()} == want
