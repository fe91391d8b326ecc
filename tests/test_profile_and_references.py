import datetime as dt
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from gridloom.operators import profile, references, skew

RULES = [
    profile.ColumnRule("v", low=0.0, high=10.0, mean_change=0.5), profile.ColumnRule("s", domain=("a", "b", "c"), share_change=0.25),
    profile.ColumnRule("p", pattern="[a-z]{2}")
]


def loads(spark, change=None, n=400):
    rng = random.Random(2)
    rows = []
    for load in (1, 2, 3, None):
        for _ in range(n):
            other = change is not None and load == 3
            v = rng.gauss(5, 1.5) + (1.2 if other and change == "mean" else 0)
            s = rng.choices("abc", (1, 6, 3) if other and change == "share" else (6, 3, 1))[0]
            p = None if other and change == "null" and rng.random() < 0.4 else rng.choice(["xy", "zz"])
            rows.append((len(rows), load, v, s, p))
    rows += [
        (10_000, 1, float("nan"), "A", "xyz"), (10_001, 1, float("inf"), "", "é"), (10_002, 2, -0.5, None, ""), (10_003, 9, 1.0, "a", "xy")
    ]
    return spark.createDataFrame(rows, "row_id long, load_id int, v double, s string, p string")


@pytest.mark.parametrize(("change", "column"), [(None, None), ("mean", "v"), ("share", "s"), ("null", "p")])
def test_shifts(spark, change, column):
    got = profile.load_changes(loads(spark, change), "t", RULES)
    assert {(r["column_name"], r["load"]) for r in got if r["shifted"]} == ({(column, 3)} if column else set())
    assert {r["load"] for r in got} == {2, 3}
    if column:
        by = {(r["column_name"], r["load"]): r for r in got}
        assert by[column, 3]["auc_only"] > 0.6 > by[column, 2]["auc_only"]
        assert by[column, 3]["auc_all"] - by[column, 3]["auc_without"] > 0.05


def test_large_loads_rule_columns_out(spark):
    got = profile.load_changes(loads(spark, "mean", 3000), "t", RULES, fit_rows=500)
    assert [
        (r["column_name"], r["load"]) for r in got if r["candidate"]
    ] == [("v", 3)] == [(r["column_name"], r["load"]) for r in got if r["shifted"]]
    by = {(r["column_name"], r["load"]): r for r in got}
    assert abs(
        by["v", 3]["seen_mean"] - by["v", 3]["mean_gap"]
    ) < 0.05 and by["v", 3]["distinguishable"] and abs(by["s", 2]["seen_share"]) < 0.05


def test_small_blocks_of_loads_agree(spark, monkeypatch):
    whole = profile.load_changes(loads(spark, "share", 300), "t", RULES)
    monkeypatch.setattr(profile, "SCORE_BYTES", 1)
    assert profile.load_changes(loads(spark, "share", 300), "t", RULES) == whole


def test_discrimination():
    rng = np.random.default_rng(1)
    for p, q in (
        ((0.5, 0.3, 0.2), (0.5, 0.3, 0.2)), ((0.5, 0.3, 0.2), (0.2, 0.3, 0.5)), ((1, 0, 0), (0, 0, 1)), ((0.1, 0.9, 0), (0.3, 0.7, 0))
    ):
        a, b = ([rng.multinomial(4000, w).astype(float) for _ in range(2)] for w in (p, q))
        assert abs(profile.discrimination(a, b) - np.abs(np.subtract(p, q)).sum() / 2) < 0.04
    none = [np.zeros(3)] * 2
    assert profile.discrimination(none, none) == 0.0 == profile.discrimination(none, [np.ones(3)] * 2)


@pytest.mark.parametrize(
    ("column", "change"),
    [
        ("t", "F.when(F.rand(1) < 0.4, 999.99).otherwise(F.col('t'))"), ("c", "F.lit('zz')"), ("t", "F.lit(float('nan'))"),
        ("c", "F.when(F.rand(1) > 0.3, F.col('c'))")
    ]
)
def test_shifts_over_cuts_and_buckets(spark, column, change):
    rules = [profile.ColumnRule("t", cuts=(0, 20, 40, 60), share_change=0.25), profile.ColumnRule("c", buckets=16, share_change=0.25)]
    df = spark.range(1200).select(
        F.col("id").alias("row_id"), (F.col("id") % 3 + 1).cast("int").alias("load_id"), (F.randn(3) * 10 + 40).alias("t"),
        F.concat(F.lit("k"), F.floor(F.rand(4) * 40).cast("string")).alias("c")
    )
    got = profile.load_changes(df.withColumn(column, F.when(F.col("load_id") == 3, eval(change)).otherwise(F.col(column))), "t", rules)
    assert {(r["column_name"], r["load"]) for r in got if r["shifted"]} == {(column, 3)} and len(got) == 4
    assert profile.load_changes(df.where("row_id < 90"), "t", rules) and not any(
        r["shifted"] for r in profile.load_changes(df.where("row_id < 90"), "t", rules)
    )


def test_all_columns_have_rules(spark, data):
    from gridloom.plans import record_queries

    keep = {"row_id", "load_id", "loaded_at"}
    for name, rules in (
        ("model_object", [*record_queries._object_rules(spark, data), *record_queries.OBJECT_MORE]),
        ("model_atom", [*record_queries.ATOM_RULES, *record_queries.ATOM_MORE])
    ):
        assert {r.name for r in rules} == set(spark.read.parquet(f"{data}/{name}.parquet").columns) - keep
        # only emd_id has no limit but that of its null share
        assert {r.name for r in rules if r.mean_change is None and r.share_change is None} <= {"emd_id"}


def test_mostly_null_columns_of_large_loads(spark):
    # every fifth value is there; of those of load 2 a share is 0, so that the means differ by 0.12 and hardly any pair tells
    df = spark.range(0, 1_000_000).select(
        F.col("id").alias("row_id"), (F.col("id") % 2 + 1).cast("int").alias("load_id"),
        F.when(
            F.pmod(F.xxhash64("id"), F.lit(5)) == 0,
            F.when((F.col("id") % 2 == 1) & (F.pmod(F.hash("id"), F.lit(100)) < 12), 0.0).otherwise(1.0)
        ).alias("v")
    )
    (got,) = profile.load_changes(df, "t", [profile.ColumnRule("v", low=0.0, high=1.0, mean_change=0.10)])
    assert abs(got["mean_gap"] + 0.12) < 0.01 and got["auc_only"] + 3 * got["auc_error"] < 0.525
    assert got["candidate"] and got["shifted"]


def test_violations_and_profile(spark):
    df = loads(spark)
    bad = {(r.column_name, r.row_id) for r in profile.violations(df, "t", RULES).collect() if r.row_id >= 10_000}
    assert bad == {("v", 10_000), ("v", 10_001), ("v", 10_002), ("s", 10_000), ("s", 10_001), ("p", 10_000), ("p", 10_001), ("p", 10_002)}
    by = {r.column_name: r for r in profile.column_profile(df, "t", RULES).collect()}
    assert by["row_id"].n_distinct == df.count() and by["s"].n_null == 1 and by["load_id"].n_null == 400 and by["s"].n_distinct == 5
    assert by["v"].max_number != by["v"].max_number  # NaN is the greatest


def test_empty_tables(spark):
    none = loads(spark).limit(0)
    assert profile.load_changes(none, "t", RULES) == [] and profile.violations(none, "t", RULES).count() == 0
    assert all(r.n_rows == 0 for r in profile.column_profile(none, "t").collect())


def slow_orphans(kids, folks):
    out = set()
    for row, k1, k2, t in kids:
        if k1 is None or k2 is None:
            continue
        mine = [(a, d) for p1, p2, a, d in folks if (p1, p2) == (k1, k2)]
        if not mine:
            out.add((row, "missing"))
            continue
        if t is None:
            continue
        alive = [a for a, d in mine if d is None or d > t]
        if not alive:
            out.add((row, "deleted"))
        elif all(a is not None and a > t for a in alive):
            out.add((row, "late"))
    return out


@pytest.mark.parametrize("least", [10_000, 5])
def test_orphans(spark, monkeypatch, least):
    rng = random.Random(9)
    day = lambda: dt.datetime(2025, 1, 1) + dt.timedelta(days=rng.randint(0, 12)) if rng.random() > 0.05 else None
    key = lambda: (rng.choice(["m", "m", "m", "n", "o", None]), rng.choice([1, 1, 2, 3, None]))
    kids = [(i, *key(), day()) for i in range(1500)]
    folks = [(*key(), day(), day() if rng.random() < 0.7 else None) for _ in range(14)]
    child = spark.createDataFrame(kids, "row_id long, key_tag string, ref int, loaded_at timestamp_ntz")
    parent = spark.createDataFrame(
        folks, "key_tag string, id int, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
    ).withColumn("row_id", F.lit(1))
    monkeypatch.setattr(references, "hot_buckets", lambda rows, b: skew.hot_buckets(rows, b, 1 / 64, least))
    refs = [
        references.Reference("c", "ref", ("key_tag", "ref"), "p", ("key_tag", "id"), "deleted_at"),
        references.Reference("c", "strict", ("key_tag", "ref"), "p", ("key_tag", "id"), "deleted_at", only_missing=True),
        references.Reference("c", "first", ("key_tag",), "p", ("key_tag",))
    ]
    got = {}
    for r in references.find_orphans({"c": child, "p": parent}, refs).collect():
        got.setdefault(r.child_column, []).append((r.row_id, r.kind))
    want = slow_orphans(kids, folks)
    assert sorted(got["ref"]) == sorted(want) and {k for _, k in want} == {"missing", "deleted", "late"}
    assert set(got["strict"]) == {x for x in want if x[1] == "missing"}
    assert set(got["first"]) == slow_orphans([(i, k, 0, t) for i, k, _, t in kids], [(k, 0, a, None) for k, _, a, _ in folks])
    assert references.find_orphans({"c": child.limit(0), "p": parent}, refs).count() == 0
    assert references.find_orphans({"c": child, "p": parent.limit(0)}, refs).where("kind <> 'missing'").count() == 0


def test_profile_of_all_kinds_and_clashing_names(spark):
    rows = [(1, "a", 1.5, True, 7, "2024-01-01"), (1, None, float("nan"), None, 8, "2024-01-02"), (None, "", float("nan"), True, 8, None), (3, "a", -0.0, False, None, "2024-01-01")]
    df = spark.createDataFrame(rows, "value int, column_name string, n double, flag boolean, big int, day string")
    df = df.select(
        "value", "column_name", "n", "flag", F.col("big").cast("decimal(20,2)").alias("big"), F.col("day").cast("date").alias("day"), F.array("value").alias("list"), F.lit(9).cast("long").alias("n_rows")
    )
    got = {r.column_name: r for r in profile.column_profile(df, "t", [profile.ColumnRule("value", low=0, high=2), profile.ColumnRule("column_name", pattern="a")]).collect()}
    assert set(got) == set(df.columns) - {"list"} and all(r.n_rows == 4 for r in got.values())
    assert [(got[c].n_null, got[c].n_distinct, got[c].top_count, got[c].n_broken) for c in ("value", "column_name", "n", "flag", "big", "day", "n_rows")] == [
        (1, 2, 2, 1), (1, 2, 2, 1), (0, 3, 2, 0), (1, 2, 2, 0), (1, 2, 2, 0), (1, 2, 2, 0), (0, 1, 4, 0)
    ]
    assert (got["value"].min_number, got["value"].max_number, got["column_name"].min_text, got["big"].max_number, got["day"].max_number) == (1.0, 3.0, "", 8.0, 1704153600.0)
    assert {r.n_distinct for r in profile.column_profile(df.limit(0), "t").collect()} == {0}
