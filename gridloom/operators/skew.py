"""Keys that hold a large share of all rows: which they are, and joins that don't send them to one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of at most this many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32_000_000
BUCKETS = 4096
#: A bucket that holds more than this share of all rows (twice the average) is split into parts of at most that share. A
#: side that is repeated for each part then grows by less than its own size, as the parts of all hot buckets are at most
#: 1 / HOT_SHARE, a half of the buckets.
HOT_SHARE = 2 / BUCKETS


def bucket_of(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(rows: DataFrame, bucket: Column, share: float = HOT_SHARE, least: int = 10_000) -> dict[int, int]:
    """The key buckets above ``share`` of all rows, with the number of salts each needs. Runs one job.

    Rows are counted by one of BUCKETS hash buckets, so that the count shuffles at most BUCKETS rows a task, whatever
    the keys; at most 1 / share buckets come to the driver.
    """
    counts = rows.groupBy(bucket.alias("b")).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    limit = max(least, int(total * share))
    return {r["b"]: -(-r["count"] // limit) for r in counts.where(F.col("count") > limit).collect()}


def n_salts(hot: dict[int, int], bucket: Column) -> Column:
    """Number of salts of a row's bucket, 1 where it isn't hot; looked up by place."""
    if not hot:
        return F.lit(1)
    salts = np.ones(BUCKETS, np.int32)
    for b, n in hot.items():
        salts[b] = n
    return F.element_at(F.lit(salts), bucket + 1)


def bounded_join(rows: DataFrame, small: DataFrame, on: Column, small_rows: int, how: str = "inner", row_bytes: int = 160) -> DataFrame:
    """Join with a table whose size decides: broadcast up to BROADCAST_BYTES, else a shuffled join, in which AQE splits skewed
    partitions. ``small_rows`` is its counted number of rows, ``row_bytes`` what one of them holds at most."""
    return rows.join(F.broadcast(small) if small_rows * row_bytes <= BROADCAST_BYTES else small, on, how)
