"""References to records that do not exist, were deleted, or arrive later."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.operators.skew import bucket_of, hot_buckets, n_salts


@dataclass(frozen=True)
class Reference:
    """A foreign key of one or two columns, the first a string. ``only_missing``: deleted and late parents are no cases."""

    child_table: str
    child_column: str
    child_keys: tuple[str, ...]
    parent_table: str
    parent_keys: tuple[str, ...]
    deleted_column: str | None = None
    child_filter: str = "true"
    only_missing: bool = False


def find_orphans(
    tables: Mapping[str, DataFrame], references: Sequence[Reference], row_id: str = "row_id", arrived: str = "loaded_at"
) -> DataFrame:
    """Every reference whose parent is missing, deleted or late, all references in one co-partitioned merge.

    Parent rows become validity intervals [arrived, deleted), at most one for each key and deletion time (the earliest
    start), combined before they are shuffled. Intervals and references are hashed to the same partitions, sorted by key
    and time, and merged in one pass in which the number of open intervals, the start of the never deleted one and the
    last deletion run along. Keys with a large share of the references are found by a count over hash buckets; their
    references are salted over tasks and only their few intervals repeated for each salt.

    Result: child_table, child_column STRING, row_id (as stored), kind STRING (missing, deleted, late), arrived (the
    child's time). References with a null in any key column are no cases. A child without time can only be missing; a
    parent without time is taken to have been there always, one without deletion time to stay. Repeated child rows give a
    row each; empty tables work. Runs one small job for the hot keys.
    """
    far = "9999-12-31 00:00:00"
    kids, folks = None, None
    for no, r in enumerate(references):
        two = len(r.child_keys) > 1
        child = tables[r.child_table].where(r.child_filter)
        k2 = lambda cols: F.col(f"`{cols[1]}`").cast("long") if two else F.lit(0).cast("long")  # noqa: B023, E731
        c = child.select(
            F.lit(no).alias("ref"), F.col(f"`{r.child_keys[0]}`").cast("string").alias("k1"), k2(r.child_keys).alias("k2"),
            F.col(f"`{arrived}`").alias("time"), F.col(f"`{row_id}`").alias("row_id")
        )
        c = c.where(F.col("k1").isNotNull() & F.col("k2").isNotNull())
        kids = c if kids is None else kids.unionAll(c)
        kind = tables[r.child_table].schema[arrived].dataType
        p = tables[r.parent_table].select(
            F.col(f"`{r.parent_keys[0]}`").cast("string").alias("k1"), k2(r.parent_keys).alias("k2"),
            F.coalesce(F.col(f"`{arrived}`").cast(kind), F.lit("0001-01-01 00:00:00").cast(kind)).alias("since"),
            F.coalesce(
                F.col(f"`{r.deleted_column}`").cast(kind) if r.deleted_column else F.lit(None).cast(kind), F.lit(far).cast(kind)
            ).alias("until"),
        ).where(F.col("k1").isNotNull() & F.col("k2").isNotNull())
        p = p.groupBy("k1", "k2", "until").agg(F.min("since").alias("since")) if r.deleted_column else p.groupBy("k1", "k2").agg(
            F.min("since").alias("since"), F.first("until").alias("until")
        )
        p = p.select(F.lit(no).alias("ref"), "k1", "k2", "since", "until")
        folks = p if folks is None else folks.unionAll(p)
    bucket = bucket_of("ref", "k1", "k2")
    hot = hot_buckets(kids, bucket)
    if hot:
        kids = kids.withColumn("salt", F.pmod(F.xxhash64("row_id", "time"), n_salts(hot, bucket)).cast("int"))
        folks = folks.withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts(hot, bucket).cast("int") - 1)))
    else:
        kids, folks = kids.withColumn("salt", F.lit(0)), folks.withColumn("salt", F.lit(0))
    time_type = kids.schema["time"].dataType
    ends = F.col("until") < F.lit(far).cast(time_type)
    none = F.lit(None).cast(time_type)
    head = F.struct(
        none.alias("time"), F.lit(0).alias("step"), F.when(~ends, F.col("since")).alias("stays_from"), F.col("until").alias("last_end")
    )
    opens = F.struct(F.col("since").alias("time"), F.lit(1).alias("step"), none.alias("stays_from"), none.alias("last_end"))
    closes = F.struct(F.col("until").alias("time"), F.lit(-1).alias("step"), none.alias("stays_from"), none.alias("last_end"))
    events = F.when(ends & (F.col("since") < F.col("until")), F.array(head, opens, closes)).otherwise(F.array(head))
    place = ["ref", "k1", "k2", "salt"]
    parents = folks.select(*place, F.explode(events).alias("e")).select(
        *place, F.col("e.time").alias("time"), F.lit(0).alias("is_child"), F.col("e.step").alias("step"),
        F.col("e.stays_from").alias("stays_from"), F.col("e.last_end").alias("last_end"),
        F.lit(None).cast(kids.schema["row_id"].dataType).alias("row_id")
    )
    children = kids.select(
        *place, "time", F.lit(1).alias("is_child"), F.lit(0).alias("step"), none.alias("stays_from"), none.alias("last_end"), "row_id"
    )
    run = W.partitionBy(*place).orderBy(F.col("time").asc_nulls_first(), "is_child").rowsBetween(W.unboundedPreceding, 0)
    merged = parents.unionAll(children).select(
        "ref", "time", "is_child", "row_id", F.sum("step").over(run).alias("open"), F.min("stays_from").over(run).alias("stays_from"),
        F.max("last_end").over(run).alias("last_end")
    )
    kind = (
        F.when(F.col("last_end").isNull(), "missing")
        .when(F.col("time").isNull(), None)
        .when(F.col("last_end") <= F.col("time"), "deleted")
        .when((F.col("open") <= 0) & ~F.coalesce(F.col("stays_from") <= F.col("time"), F.lit(False)), "late")
    )
    named = lambda f: F.element_at(F.array(*[F.lit(getattr(r, f)) for r in references]), F.col("ref") + 1)
    strict = [i for i, r in enumerate(references) if r.only_missing]
    out = merged.where("is_child = 1").withColumn("kind", kind).where(F.col("kind").isNotNull())
    if strict:
        out = out.where(~F.col("ref").isin(strict) | (F.col("kind") == "missing"))
    return out.select(
        named("child_table").alias("child_table"), named("child_column").alias("child_column"), "row_id", "kind",
        F.col("time").alias("arrived")
    )


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Number of orphans by child table, column, kind and month of the child's arrival (null for children without time)."""
    return orphans.groupBy(
        "child_table", "child_column", "kind", F.date_format("arrived", "yyyy-MM").alias("month")
    ).agg(F.count(F.lit(1)).alias("n_orphans"))
