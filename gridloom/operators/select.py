"""Selections: pick and veto lists, chains, boxes and thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The main-chain spots of amino acids and of nucleotides.
MAIN_CHAIN_AMINO = ("CA", "C", "N", "O")
MAIN_CHAIN_NUCLEIC = ("P", "OP1", "OP2", "O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "C2'", "O2'", "C1'")


def parse_names(text: str) -> list[str]:
    """Names of a comma list, blanks trimmed, empty ones left out."""
    return [x for x in (p.strip() for p in text.split(",")) if x]


def pick_veto(picks: Mapping[str, Sequence], vetoes: Mapping[str, Sequence]) -> Column:
    """True for rows that every non-empty pick list contains and no veto list does; a veto wins. A null value is in no list."""
    keep = F.lit(True)
    for c, values in picks.items():
        if len(values):
            keep = keep & F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    for c, values in vetoes.items():
        if len(values):
            keep = keep & ~F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    return keep


def first_chains(atoms: DataFrame, chain_map: DataFrame, keys: Sequence[str] = (), asymmetric: bool = False) -> DataFrame:
    """Atoms whose chain is the first of some entity. All atoms if ``asymmetric`` or where the map has no rows.

    ``chain_map``: keys, entity_id, chain_ordinal, chain_id.
    """
    if asymmetric:
        return atoms
    if not keys and chain_map.isEmpty():
        return atoms
    heads = chain_map.groupBy(*keys, "entity_id").agg(
        F.min_by("chain_id", "chain_ordinal").alias("chain_id")
    ).select(*keys, "chain_id").distinct()
    kept = atoms.join(heads, [*keys, "chain_id"], "left_semi")
    return kept if not keys else kept.unionByName(atoms.join(chain_map.select(*keys).distinct(), list(keys), "left_anti"))


def bonds_of_chains(bonds: DataFrame, atoms: DataFrame, chain_map: DataFrame, keys: Sequence[str], asymmetric: bool = False) -> DataFrame:
    """Bonds whose first atom is kept by first_chains()."""
    if asymmetric:
        return bonds
    kept = first_chains(atoms, chain_map, keys).select(*keys, F.col("serial_id").alias("atom_serial_id_1"))
    return bonds.join(kept, [*keys, "atom_serial_id_1"], "left_semi")


def bounding_box(points: DataFrame, keys: Sequence[str], axes: Sequence[str], margin: float) -> DataFrame:
    """Range of each axis widened by ``margin``: keys, low_a, high_a."""
    return points.groupBy(*keys).agg(
        *[x for a in axes for x in ((F.min(a) - margin).alias(f"low_{a}"), (F.max(a) + margin).alias(f"high_{a}"))]
    )


def in_box(rows: DataFrame, box: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Rows inside their key's box, ends included; the box table has one row a key and is joined by its size."""
    inside = F.lit(True)
    for a in axes:
        inside = inside & F.col(a).between(F.col(f"low_{a}"), F.col(f"high_{a}"))
    return rows.join(box, list(keys)).where(inside).select(*[rows[c] for c in rows.columns])


def above_share_of_max(rows: DataFrame, value: str, share: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose value exceeds ``share`` of their key's maximum (of all rows without keys, found by a job)."""
    if not keys:
        top = rows.agg(F.max(value)).first()[0]
        return rows.where(F.col(value) > F.lit(top) * share)
    m = rows.groupBy(*keys).agg(F.max(value).alias("__max"))
    return rows.join(m, list(keys)).where(F.col(value) > F.col("__max") * share).drop("__max")


def slab(rows: DataFrame, axis: str, low: float, high: float, keys: Sequence[str] = (), centred: bool = False) -> DataFrame:
    """Rows with low <= axis < high, relative to the key's mean position if ``centred``."""
    if not centred:
        return rows.where((F.col(axis) >= low) & (F.col(axis) < high))
    m = rows.groupBy(*keys).agg(F.avg(axis).alias("__mean"))
    j = rows.join(m, list(keys))
    at = F.col(axis) - F.col("__mean")
    return j.where((at >= low) & (at < high)).drop("__mean")


def is_main_chain(atom_id: Column) -> Column:
    return F.coalesce(atom_id.isin([*MAIN_CHAIN_AMINO, *MAIN_CHAIN_NUCLEIC]), F.lit(False))


def is_unknown(element: Column, component: Column, spot: Column) -> Column:
    """Any of the three codes unknown (0 or null)."""
    return (F.coalesce(element, F.lit(0)) == 0) | (F.coalesce(component, F.lit(0)) == 0) | (F.coalesce(spot, F.lit(0)) == 0)


def fit_members(samples: DataFrame, key: str, value: str, least: int = 500) -> DataFrame:
    """Entities with at least ``least`` positive samples."""
    return samples.where(F.col(value) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("n_samples")).where(F.col("n_samples") >= least)


def fit_groups(members: DataFrame, group: Sequence[str], order: str, flag: str, least: int = 10) -> DataFrame:
    """Groups of at least ``least`` members whose first member (by ``order``) is flagged."""
    g = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n_members"), F.min_by(flag, order).alias("__first"))
    return g.where((F.col("n_members") >= least) & F.col("__first")).drop("__first")


def has_any(df: DataFrame, condition: Column) -> bool:
    return not df.where(condition).limit(1).isEmpty()
