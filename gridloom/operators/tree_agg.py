"""Aggregates by key through a tree of merges, for keys of which a few hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an input chunk, and states that a node of the next round merges.
CHUNK_ROWS = 65_536
FAN_IN = 8


def rounds(n_rows: int, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, splits: int = 0) -> list[int]:
    """Nodes of each merge round, the last being 1: every node merges about ``fan_in`` of the round before. Chunks don't reach
    over splits, of which each has one that isn't full."""
    widths, w = [], max(1, -(-n_rows // chunk_rows) + splits)
    while w > 1:
        w = -(-w // fan_in)
        widths.append(w)
    return widths or [1]


def key_stats(
    df: DataFrame, key_columns: Sequence[str], value_columns: Sequence[str], chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN,
    n_rows: int | None = None
) -> DataFrame:
    """Counts, means and extremes of the value columns for each key of each key column.

    Input rows are numbered within their split and cut into chunks of ``chunk_rows``. A chunk's rows are combined by key
    where they are read; the states go to the chunk's node, and rounds of fan-in ``fan_in`` merge nodes until one is
    left. So no task gets the states of a hot key from all chunks, however many rows the key has, and what a round moves
    is bounded by nodes x keys.

    Result: column_name STRING, key_value STRING (the key as stored, null for null keys), n_rows LONG, and for each value
    column v: v_n LONG (values that are neither null nor NaN), v_nan LONG, v_mean, v_min, v_max DOUBLE (null without
    values). Repeated rows count each. An empty table gives no rows. Other columns are ignored. Runs a count of the rows
    (file footers) unless ``n_rows`` is given.
    """
    if n_rows is None:
        n_rows = df.count()
    row = F.monotonically_increasing_id()
    chunk = F.struct(
        F.shiftright(row, 33).alias("split"), F.floor((row.bitwiseAND(F.lit((1 << 33) - 1))) / F.lit(chunk_rows)).alias("chunk")
    )
    widths = rounds(n_rows, chunk_rows, fan_in, df.rdd.getNumPartitions())
    parts = None
    for c in key_columns:
        vs = [F.col(f"`{v}`").cast("double").alias(f"v{i}") for i, v in enumerate(value_columns)]
        p = df.select(
            F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("key_value"), *vs,
            F.pmod(F.xxhash64(chunk), F.lit(widths[0])).alias("node")
        )
        parts = p if parts is None else parts.unionAll(p)
    ok = {i: F.col(f"v{i}").isNotNull() & ~F.isnan(f"v{i}") for i in range(len(value_columns))}
    first = [F.count(F.lit(1)).alias("n_rows")]
    merge = [F.sum("n_rows").alias("n_rows")]
    for i in ok:
        v = F.when(ok[i], F.col(f"v{i}"))
        first += [
            F.count(v).alias(f"n{i}"), F.count_if(F.isnan(f"v{i}")).alias(f"nan{i}"), F.sum(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}")
        ]
        merge += [
            F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"nan{i}").alias(f"nan{i}"), F.sum(f"s{i}").alias(f"s{i}"),
            F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}")
        ]
    state = parts.groupBy("column_name", "key_value", "node").agg(*first)
    for w in widths[1:]:
        state = state.groupBy("column_name", "key_value", F.pmod("node", F.lit(w)).alias("node")).agg(*merge)
    out = [F.col("column_name"), F.col("key_value"), F.col("n_rows")]
    for i, v in enumerate(value_columns):
        out += [
            F.col(f"n{i}").alias(f"{v}_n"), F.col(f"nan{i}").alias(f"{v}_nan"),
            F.try_divide(F.col(f"s{i}"), F.col(f"n{i}")).alias(f"{v}_mean"), F.col(f"lo{i}").alias(f"{v}_min"),
            F.col(f"hi{i}").alias(f"{v}_max")
        ]
    return state.select(*out)


def heavy_keys(states: DataFrame, percent: int = 8) -> DataFrame:
    """The non-null keys with at least ``percent`` % of all rows, from the (materialized) result of key_stats.

    Result: column_name, key_value STRING. All rows count, copies and those with a null key too.
    """
    one = states.where(F.col("column_name") == F.lit(states.select("column_name").first()[0])) if states.take(1) else states
    total = one.agg(F.sum("n_rows")).first()[0] or 0
    return states.where(
        F.col("key_value").isNotNull() & (F.col("n_rows") * 100 >= F.lit(total * percent))
    ).select("column_name", "key_value")
