"""Joins of entity tables: intervals, first matches, dictionaries, fallbacks, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def label_intervals(
    rows: DataFrame, ranges: DataFrame, keys: Sequence[str], position: str, low: str = "low", high: str = "high", label: str = "label",
    priority: str = "priority", order: str = "range_id", default=None, step: int = 64
) -> DataFrame:
    """Each row with the label of the range (of its keys) that holds its position, ends included.

    Of several the least ``priority``, then the least ``order`` wins; rows without one get ``default``. Ranges are cut
    into steps of ``step`` positions and joined by key and step, so that a key with many rows or ranges isn't compared
    pairwise; a long range only costs its steps. Ranges with a null or reversed bound hold nothing. Positions are integers.
    """
    r = ranges.where(F.col(low) <= F.col(high)).select(
        *keys, F.col(low).cast("long").alias("__lo"), F.col(high).cast("long").alias("__hi"), F.col(label).alias("__label"),
        F.col(priority).alias("__p"), F.col(order).alias("__o")
    )
    r = r.withColumn("__s", F.explode(F.sequence(F.floor(F.col("__lo") / step), F.floor(F.col("__hi") / step))))
    spots = rows.select(
        *keys, F.col(position).cast("long").alias("__at")
    ).where("__at is not null").distinct().withColumn("__s", F.floor(F.col("__at") / step))
    hit = spots.join(r, [*keys, "__s"]).where(F.col("__at").between(F.col("__lo"), F.col("__hi")))
    best = hit.groupBy(*keys, "__at").agg(F.min_by("__label", F.struct("__p", "__o")).alias("__label"))
    j = rows.withColumn("__at", F.col(position).cast("long")).join(best, [*keys, "__at"], "left")
    return j.select(*[rows[c] for c in rows.columns], F.coalesce("__label", F.lit(default)).alias(label))


def dictionary(rows: DataFrame, column: str, dim: DataFrame, name: str, code: str, unknown: int = 0, out: str | None = None) -> DataFrame:
    """Codes of names; names that the dimension lacks, and nulls, get ``unknown``. Repeated names keep their least code."""
    d = dim.groupBy(F.col(name).alias("__name")).agg(F.min(code).alias("__code"))
    j = rows.join(d, F.col(column) == F.col("__name"), "left")
    return j.select(*[rows[c] for c in rows.columns], F.coalesce("__code", F.lit(unknown)).alias(out or code))


def first_match(left: DataFrame, right: DataFrame, on: Sequence[str], order: str, take: Sequence[str], how: str = "inner") -> DataFrame:
    """Each left row with the right row of least ``order`` among those of equal keys; the right side is reduced to one row a
    key before the join, so rows are never multiplied."""
    best = right.groupBy(*on).agg(F.min_by(F.struct(*take), order).alias("__r"))
    return left.join(best, list(on), how).select(*left.columns, *[F.col(f"__r.{t}").alias(t) for t in take])


def normalized_by_reference(
    rows: DataFrame, reference_rows: DataFrame, key: str, value: str, order: str, reference: float | Column
) -> DataFrame:
    """``value`` minus (the reference row's value of the same key - ``reference``); rows without one are unchanged. Of
    several reference rows of a key the last by ``order`` counts."""
    ref = reference_rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(value, order).alias("__v"))
    target = reference if isinstance(reference, Column) else F.lit(float(reference))
    j = rows.join(ref, F.col(key) == F.col("__key"), "left")
    return j.select(
        *[rows[c] for c in rows.columns], (F.col(value) - F.coalesce(F.col("__v") - target, F.lit(0.0))).alias(f"{value}_normalized")
    )


def lookup_with_fallback(
    rows: DataFrame, targets: DataFrame, exact: Sequence[str], loose: Sequence[str], order: str, take: str
) -> DataFrame:
    """``take`` of the target with all ``exact`` keys, else of the one of least ``order`` with the ``loose`` keys."""
    a = targets.groupBy(*exact).agg(F.min_by(take, order).alias("__a"))
    b = targets.groupBy(*loose).agg(F.min_by(take, order).alias("__b"))
    j = rows.join(a, list(exact), "left").join(b, list(loose), "left")
    return j.select(*[rows[c] for c in rows.columns], F.coalesce("__a", "__b").alias(take))


def both_ends_in(
    bonds: DataFrame, atoms: DataFrame, keys: Sequence[str], serial: str = "serial_id",
    ends: Sequence[str] = ("atom_serial_id_1", "atom_serial_id_2")
) -> DataFrame:
    """Bonds both of whose atoms are in ``atoms``; two semi-joins."""
    for e in ends:
        bonds = bonds.join(atoms.select(*keys, F.col(serial).alias(e)), [*keys, e], "left_semi")
    return bonds


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has: keys, side (left_only, right_only)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right_only"))
    )


def mark_present(rows: DataFrame, entries: DataFrame, keys: Sequence[str], flag: str = "is_selected") -> DataFrame:
    """Rows merged with their entry, if any, and whether there is one. Entries are unique by key."""
    e = entries.withColumn("__there", F.lit(True))
    return rows.join(e, list(keys), "left").withColumn(flag, F.coalesce("__there", F.lit(False))).drop("__there")


def union_labelled(parts: dict[str, DataFrame], label: str = "label") -> DataFrame:
    out = None
    for name, df in parts.items():
        d = df.withColumn(label, F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def unordered_pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs with the smaller end first."""
    return edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a).isNotNull()).distinct()


def build_bonds(atoms: DataFrame, allowed: DataFrame, radius: float = 2.0) -> DataFrame:
    """Bonds between atoms of one model closer than ``radius`` whose names form a known bond.

    ``atoms``: key_tag, model_number, serial_id, chain_id, sequence_id, component_id, atom_id, x, y, z. ``allowed``:
    component_id, atom_1, atom_2 of bonds within a component (same component and sequence), and rows with component_id null
    for links between neighbours in the sequence (same chain, the first atom's sequence + 1). A pair matches in either order.
    """
    from gridloom.operators.spatial import range_join

    later = F.col("l.serial_id") < F.col("r.serial_id")
    j = range_join(atoms, atoms, ("x", "y", "z"), radius, ("key_tag", "model_number"), later)
    p = j.select(
        "l.key_tag", "l.model_number", F.col("l.serial_id").alias("s1"), F.col("r.serial_id").alias("s2"), F.col("l.chain_id").alias("c1"),
        F.col("r.chain_id").alias("c2"), F.col("l.sequence_id").alias("q1"), F.col("r.sequence_id").alias("q2"),
        F.col("l.component_id").alias("n1"), F.col("r.component_id").alias("n2"), F.col("l.atom_id").alias("a1"),
        F.col("r.atom_id").alias("a2"), "distance"
    )
    both = allowed.select(
        "component_id", F.col("atom_1").alias("a1"), F.col("atom_2").alias("a2")
    ).unionAll(allowed.select("component_id", F.col("atom_2"), F.col("atom_1"))).distinct()
    same = p.where("n1 = n2 and c1 = c2 and q1 = q2").join(
        both.where("component_id is not null").withColumnRenamed("component_id", "n1"), ["n1", "a1", "a2"], "left_semi"
    )
    links = allowed.where("component_id is null").select("atom_1", "atom_2")
    near = p.where("c1 = c2 and abs(q1 - q2) = 1").withColumn(
        "atom_1", F.when(F.col("q1") < F.col("q2"), F.col("a1")).otherwise(F.col("a2"))
    ).withColumn(
        "atom_2", F.when(F.col("q1") < F.col("q2"), F.col("a2")).otherwise(F.col("a1"))
    ).join(links, ["atom_1", "atom_2"], "left_semi")
    cols = [
        "key_tag", "model_number", F.col("s1").alias("atom_serial_id_1"), F.col("s2").alias("atom_serial_id_2"),
        F.concat_ws("_", "a1", "a2").alias("bond_id"), "distance"
    ]
    return same.select(*cols).unionAll(near.select(*cols))


def rank_of_values(rows: DataFrame, keys: Sequence[str], member: str, members: Sequence, value: str) -> DataFrame:
    """Competition rank (ties share the lowest) of ``members`` within each key; a missing member counts as value 0.

    Result: keys, member, rank INT. The tuple is short and pivoted, so ranks need no sort."""
    p = rows.where(F.col(member).isin(list(members))).groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col(member) == m, F.col(value))), F.lit(0.0)).alias(f"__{i}") for i, m in enumerate(members)]
    )
    all_ = F.array(*[F.col(f"__{i}") for i in range(len(members))])

    def below(i: int) -> Column:
        return F.size(F.filter(all_, lambda v: v < F.col(f"__{i}")))

    each = F.array(*[F.struct(F.lit(m).alias("m"), (below(i) + 1).alias("r")) for i, m in enumerate(members)])
    return p.select(*keys, F.explode(each).alias("e")).select(*keys, F.col("e.m").alias(member), F.col("e.r").cast("int").alias("rank"))


def running_count(rows: DataFrame, keys: Sequence[str], order: str, condition: Column, out: str) -> DataFrame:
    """Number of rows so far (before this one) that meet the condition, from 1, as a file's model number counts its ends."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, (F.coalesce(F.sum(F.when(condition, 1).otherwise(0)).over(w), F.lit(0)) + 1).cast("int"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def next_in_sequence(rows: DataFrame, keys: Sequence[str], sequence: str, take: Sequence[str]) -> DataFrame:
    """Each row with the rows one further in the sequence of its keys, their columns as next_*."""
    n = rows.select(*keys, (F.col(sequence) - 1).alias(sequence), *[F.col(t).alias(f"next_{t}") for t in take])
    return rows.join(n, [*keys, sequence])
