"""Ranks and running totals over keys of any size: no key, and no value, is gathered in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.session import materialize


#: Rows of a group whose values one task may hold.
TASK_ROWS = 1_000_000


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, out: str) -> DataFrame:
    """Each row with ``out``, the sum of ``amount`` over the rows of its keys before it by ``order`` (0 for the first).

    Rows are sorted by range over all tasks, so that a key with most rows spans many of them; each part sums its own rows, and
    the parts' totals, one row a part and key, are added up. Equal rows have an order of their own. Null keys are a key; null
    amounts count 0. Runs jobs and writes the sorted rows once.
    """
    keys, order = list(keys), list(order)
    sorted_ = df.withColumn("__amount", F.coalesce(amount, F.lit(0)).cast("long")).withColumn("__tie", F.monotonically_increasing_id())
    parts = materialize(sorted_.repartitionByRange(*keys, *order, "__tie").withColumn("__part", F.spark_partition_id()))
    held = parts.groupBy("__part", *keys).agg(F.sum("__amount").alias("__held"))
    start = held.withColumn(
        "__start", F.coalesce(F.sum("__held").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("__held")
    inner = F.coalesce(
        F.sum("__amount").over(W.partitionBy("__part", *keys).orderBy(*order, "__tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    local = parts.withColumn("__inner", inner)
    j = local.join(start, _same(local, start, ["__part", *keys]))  # AQE knows the size of the parts' totals
    return j.select(*[local[c] for c in df.columns], (F.col("__start") + F.col("__inner")).alias(out))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Row numbers from 1 within each key, as row_number() gives them, over keys (or a whole table) of any size."""
    return running_totals(df, keys, order, F.lit(1), "__before").withColumn(out, F.col("__before") + 1).drop("__before")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, levels: Mapping[str, float], task_rows: int = TASK_ROWS) -> DataFrame:
    """Exact percentiles of each group: keys, a column for each of ``levels`` (name -> p), linear between ranks at p (n - 1).

    p <= 0 gives 0 and p >= 1 the maximum, as in stats.percentile(). Null and NaN values are left out; a group without others
    has 0 everywhere. Groups of up to ``task_rows`` rows are aggregated where their values are; if one has more, all are ranked
    by running_totals() over counted values, so repeated ones cost nothing. Both give the same. Runs jobs.
    """
    keys = list(keys)
    v = F.col(f"`{value}`").cast("double")
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= task_rows:
        real = F.when(~F.isnan(v), v)
        between = [p for p in levels.values() if 0 < p < 1]
        one = df.groupBy(*keys).agg(
            F.percentile(real, F.array(*[F.lit(float(p)) for p in between] or [F.lit(0.5)])).alias("__p"), F.max(real).alias("__max")
        )
        pick = lambda p: F.lit(0.0) if p <= 0 else F.col("__max") if p >= 1 else F.col("__p")[between.index(p)]
        return one.select(*keys, *[F.coalesce(pick(p), F.lit(0.0)).alias(name) for name, p in levels.items()])
    counted = df.select(*keys, v.alias("__v")).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__cnt"))
    counted = materialize(counted)
    real = counted.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    totals = real.groupBy(*keys).agg(F.sum("__cnt").alias("__n"), F.max("__v").alias("__max"))
    placed = running_totals(real, keys, ["__v"], F.col("__cnt"), "__before")
    j = placed.join(totals, _same(placed, totals, keys)).select(*[placed[k] for k in keys], "__v", "__cnt", "__before", "__n")
    picks = []
    for i, p in enumerate(x for x in levels.values() if 0 < x < 1):
        at = F.lit(float(p)) * (F.col("__n") - 1)
        held = lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col("__cnt"))
        low, high = F.floor(at), F.ceil(at)
        picks += [F.max(F.when(held(low), F.col("__v"))).alias(f"__l{i}"), F.max(F.when(held(high), F.col("__v"))).alias(f"__h{i}")]
    found = totals if not picks else j.groupBy(*keys).agg(*picks)
    groups = counted.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    for other in ([found] if found is totals else [found, totals]):
        renamed = other.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
            *[c for c in other.columns if c not in keys and c not in groups.columns]
        )
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & groups[k].eqNullSafe(renamed[f"__k{i}"])
        groups = groups.join(renamed, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    out, i = [F.col(k) for k in keys], 0
    for name, p in levels.items():
        if p <= 0:
            x = F.lit(0.0)
        elif p >= 1:
            x = F.col("__max")
        else:
            at = F.lit(float(p)) * (F.col("__n") - 1)
            low, high = F.col(f"__l{i}"), F.col(f"__h{i}")
            x = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
            i += 1
        out.append(F.coalesce(x, F.lit(0.0)).alias(name))
    return groups.select(*out)
