"""Percentiles by group through exact bisection, and their combination over periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.operators.skew import bounded_join
from gridloom.session import materialize

#: Steps of the percentile grid; the ranks of combined periods are then known to 1 / GRID of the rows.
GRID = 64
#: Cells of the first pass in each unit of log(1 + |x|), and parts into which a pass cuts an interval.
FIRST_CELLS = 64
PARTS = 1024
GROUP = ["column_name", "key_value", "period"]


def _levels(grid: int, extra: Sequence[float]) -> list[float]:
    return sorted({i / grid for i in range(grid + 1)} | {float(p) for p in extra})


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def _located(cells: DataFrame, within: list[str], order: str) -> DataFrame:
    """Cells that hold a target rank: with the rows before them in ``before`` and only their targets in ``targets``."""
    w = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    c = cells.withColumn("before", F.col("base") + F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    return c.withColumn(
        "targets", F.filter("targets", lambda t: (t["rank"] > F.col("before")) & (t["rank"] <= F.col("before") + F.col("cnt")))
    ).where(F.size("targets") > 0)


def _answers(cells: DataFrame) -> DataFrame:
    return cells.select(*GROUP, F.col("n"), F.explode("targets").alias("t"), "lo", "hi").select(
        *GROUP, "n", F.col("t.p").alias("p"), F.col("t.rank").alias("rank"), F.col("lo").alias("value_low"), F.col("hi").alias("value_high")
    )


def quantile_summary(
    df: DataFrame,
    group_columns: Sequence[str],
    value_column: str,
    period_column: str,
    grid: int = GRID,
    percentiles: Sequence[float] = (0.01, 0.05, 0.1, 0.9, 0.95, 0.99),
    max_passes: int | None = None,
) -> DataFrame:
    """Order statistics of ``value_column`` for each key of each group column and each period, by exact bisection.

    For every group there is a value interval per percentile. A pass counts, over the rows inside the open intervals, how
    many lie below each of the interval's midpoints (PARTS - 1 of them, i.e. ten halvings in one scan) together with the
    least and greatest value between midpoints; the interval shrinks to the part that holds the target rank and to the
    values that occur there. An interval is resolved when one value is left in it. The first pass needs no interval: it
    cuts all values at fixed points evenly spaced in log(1 + |x|), so that far outliers don't widen it. Only counts by
    group and part are shuffled; after two passes the few rows in open intervals are written and read instead of the table.

    Result, one row for each group, period and percentile p (the grid i / ``grid`` and ``percentiles``): column_name,
    key_value STRING, period (as stored), n LONG (values), n_null, n_nan LONG, p DOUBLE, rank LONG (max(1, ceil(p n))),
    value_low, value_high DOUBLE, merge_rank_error LONG. The value of that rank lies in [value_low, value_high]; the two
    are equal unless ``max_passes`` ended the search (by default it ends when every rank is resolved: ten halvings a pass
    resolve 64-bit values in seven). Null and NaN values are counted and left out, infinities are values
    at the ends. Null keys and periods are groups of their own; equal values share ranks, repeated rows count each; groups
    without values and empty tables give no rows. combine() gives percentiles of several periods from these rows alone,
    with a rank error of at most the sum of their merge_rank_error. Runs jobs.
    """
    levels = _levels(grid, percentiles)
    x = F.col("x")
    parts = None
    for c in group_columns:
        p = df.select(
            F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("key_value"), F.col(f"`{period_column}`").alias("period"),
            F.col(f"`{value_column}`").cast("double").alias("x")
        )
        parts = p if parts is None else parts.unionAll(p)
    # -0.0 and 0.0 are one value
    parts = parts.withColumn("x", F.col("x") + F.lit(0.0))
    usable = x.isNotNull() & ~F.isnan(x)
    log = F.when(F.abs(x) == F.lit(float("inf")), F.signum(x) * F.lit(1e6)).otherwise(F.signum(x) * F.log1p(F.abs(x)))
    cell = F.when(usable, F.floor(log * FIRST_CELLS)).cast("long").alias("cell")
    first = materialize(
        parts.groupBy(*GROUP, cell).agg(
            F.count(F.lit(1)).alias("cnt"), F.count_if(x.isNull()).alias("n_null"), F.count_if(F.isnan(x)).alias("n_nan"),
            F.min(F.when(usable, x)).alias("lo"), F.max(F.when(usable, x)).alias("hi")
        )
    )
    g = W.partitionBy(*GROUP)
    counted = first.withColumns(
        {
            "n": F.sum(F.when(F.col("cell").isNotNull(), F.col("cnt"))).over(g), "n_null": F.sum("n_null").over(g),
            "n_nan": F.sum("n_nan").over(g)
        }
    ).where(F.col("cell").isNotNull())
    sizes = counted.select(*GROUP, "n_null", "n_nan").distinct()
    ranks = F.transform(
        F.array(*[F.lit(p) for p in levels]),
        lambda p: F.struct(p.alias("p"), F.greatest(F.lit(1), F.ceil(p * F.col("n"))).cast("long").alias("rank"))
    )
    cells = materialize(
        _located(
            counted.select(*GROUP, "cell", "cnt", "lo", "hi", "n", F.lit(0).cast("long").alias("base"), ranks.alias("targets")), GROUP,
            "cell"
        )
    )
    answers = [_answers(cells.where("lo = hi"))]
    active = cells.where("lo < hi")
    n_active, passes, rows = active.count(), 1, None
    while n_active and (max_passes is None or passes < max_passes):
        passes += 1
        span = F.when(
            F.col("hi") - F.col("lo") < F.lit(float("inf")), (x - F.col("lo")) / (F.col("hi") - F.col("lo"))
        ).otherwise((x / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        part = F.least(F.floor(span * PARTS), F.lit(PARTS - 1)).cast("int")
        # an infinity can't be halved towards: it stands alone in the first or last cell of the first pass
        if rows is None:
            r = parts.where(usable).withColumn("cell", cell)
            keys, source = [*GROUP, "cell"], r
        else:
            keys, source = ["aid"], rows
        a = active.select(*keys, "lo", "hi")
        joined = bounded_join(source, a, _same(source, a, keys), n_active).select(*[source[k] for k in keys], "x", part.alias("part"))
        agg = joined.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("cnt"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        carried = active.select(*keys, *[k for k in GROUP if k not in keys], "n", F.col("before").alias("base"), "targets")
        nxt = bounded_join(agg, carried, _same(agg, carried, keys), n_active, row_bytes=200 + 24 * len(levels)).select(
            *[agg[k] for k in keys], *[k for k in GROUP if k not in keys], "part", "cnt", "lo", "hi", "n", "base", "targets"
        )
        found = materialize(_located(nxt, keys, "part").withColumn("next_aid", F.monotonically_increasing_id()))
        answers.append(_answers(found.where("lo = hi")))
        still = found.where("lo < hi")
        n_still = still.count()
        if n_still and (max_passes is None or passes < max_passes):
            s = still.select(*keys, "part", F.col("next_aid"))
            rows = materialize(
                bounded_join(joined, s, _same(joined, s, [*keys, "part"]), n_still).select(F.col("next_aid").alias("aid"), "x")
            )
            active = still.drop("aid").withColumnRenamed("next_aid", "aid").select("aid", *GROUP, "n", "before", "targets", "lo", "hi")
        else:
            active = still
        n_active = n_still
    if n_active:
        answers.append(_answers(active))
    out = answers[0]
    for a in answers[1:]:
        out = out.unionAll(a)
    return out.join(sizes, _same(out, sizes, GROUP)).select(
        *[out[k] for k in GROUP], "n", "n_null", "n_nan", "p", "rank", "value_low", "value_high",
        F.ceil(F.col("n") / grid).cast("long").alias("merge_rank_error")
    )


def combine(summary: DataFrame, percentiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Percentiles over all periods of a summary (or of any part of it that the caller filters), without the rows.

    Between neighbouring grid ranks of a period lie at most n / grid of its rows, so the summed ranks of all periods are
    known to within the summed merge_rank_error. The answer is the least summary value of which at least p N rows are
    known to be at or below it: its true rank is from p N to p N + rank_error.

    Result: column_name, key_value STRING, n LONG (rows N of all periods), p, value DOUBLE, rank_error LONG.
    """
    key = ["column_name", "key_value"]
    step = W.partitionBy(*GROUP).orderBy("rank", "p")
    points = summary.withColumn("w", F.col("rank") - F.coalesce(F.lag("rank").over(step), F.lit(0)))
    totals = points.groupBy(*GROUP).agg(
        F.max("n").alias("n"), F.max("merge_rank_error").alias("e")
    ).groupBy(*key).agg(F.sum("n").alias("n_all"), F.sum("e").alias("rank_error"))
    by_value = points.groupBy(*key, F.col("value_high").alias("v")).agg(F.sum("w").alias("w"))
    known = by_value.withColumn("known", F.sum("w").over(W.partitionBy(*key).orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    j = known.join(totals, _same(known, totals, key)).select(*[known[k] for k in key], "v", "known", "n_all", "rank_error")
    j = j.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    return j.where(F.col("known") >= F.col("p") * F.col("n_all")).groupBy(*key, "p").agg(
        F.first("n_all").alias("n"), F.min("v").alias("value"), F.first("rank_error").alias("rank_error")
    ).select(*key, "n", "p", "value", "rank_error")
