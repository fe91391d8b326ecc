"""Packed group keys and dictionary codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackedKey:
    """Fields from the lowest bit up, with their widths; values beyond a width lose their higher bits."""

    fields: tuple[tuple[str, int], ...]

    def pack(self, *columns: Column) -> Column:
        out, at = F.lit(0).cast("long"), 0
        for (_, bits), c in zip(self.fields, columns, strict=True):
            out = out.bitwiseOR(F.shiftleft(c.cast("long").bitwiseAND(F.lit((1 << bits) - 1)), at))
            at += bits
        return out

    def unpack(self, key: Column) -> list[Column]:
        out, at = [], 0
        for name, bits in self.fields:
            out.append(F.shiftrightunsigned(key.cast("long"), at).bitwiseAND(F.lit((1 << bits) - 1)).alias(name))
            at += bits
        return out

    def label(self, key: Column) -> Column:
        return F.concat(F.lit("<"), F.concat_ws(", ", *[c.cast("string") for c in self.unpack(key)]), F.lit(">"))


# The bit layouts of the group classes.
SIMPLE_ATOM = PackedKey((("atom_key", 16), ("flag", 1)))
COMPONENT_ATOM = PackedKey((("component_key", 8), ("atom_key", 16)))
STRUCTURE_ATOM = PackedKey((("structure", 8), ("component_key", 8), ("atom_key", 16)))
SIMPLE_BOND = PackedKey((("bond_key", 16), ("flag", 1)))
COMPONENT_BOND = PackedKey((("component_key", 8), ("bond_key", 16)))
ATOM_CLASSES = {"simple": SIMPLE_ATOM, "component": COMPONENT_ATOM, "structure": STRUCTURE_ATOM}
BOND_CLASSES = {"simple": SIMPLE_BOND, "component": COMPONENT_BOND}


def class_rows(df: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """Each row once for every class, with class_key STRING and group_key LONG; a row needs no shuffle for it."""
    return df.select(
        "*", F.explode(F.array(*[F.struct(F.lit(k).alias("class_key"), c.alias("group_key")) for k, c in classes.items()])).alias("__c")
    ).select("*", "__c.class_key", "__c.group_key").drop("__c")


def atom_classes(
    df: DataFrame, atom_key: str = "atom_key", component_key: str = "component_key", structure: str = "structure",
    flag: str = "is_special_atom"
) -> DataFrame:
    a, c, s = F.col(atom_key), F.col(component_key), F.col(structure)
    return class_rows(
        df, {"simple": SIMPLE_ATOM.pack(a, F.col(flag)), "component": COMPONENT_ATOM.pack(c, a), "structure": STRUCTURE_ATOM.pack(s, c, a)}
    )


def bond_classes(
    df: DataFrame, bond_key: str = "bond_key", component_key: str = "component_key", flag: str = "is_special_bond"
) -> DataFrame:
    b = F.col(bond_key)
    return class_rows(df, {"simple": SIMPLE_BOND.pack(b, F.col(flag)), "component": COMPONENT_BOND.pack(F.col(component_key), b)})


def encode_ids(df: DataFrame, column: str, order: str, known: DataFrame, first_new: int, limit: int | None = None) -> DataFrame:
    """Codes of all ids: those of ``known`` (id, code), and for others the next numbers from ``first_new`` by first
    occurrence in ``order`` (ties by id). Codes beyond ``limit`` are null. Result: id, code LONG, is_new BOOLEAN. Nulls have
    no code. The ids are combined before they are numbered, in parts of their order. Runs jobs."""
    from gridloom.operators.ordering import numbered

    seen = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.min(order).alias("first"))
    j = seen.join(known.select("id", F.col("code").cast("long").alias("old")), "id", "left")
    new = numbered(j.where("old is null"), [], ["first", "id"], "__no").withColumn("code", F.lit(first_new - 1) + F.col("__no"))
    code = F.when(F.col("code") <= limit, F.col("code")) if limit is not None else F.col("code")
    return j.where("old is not null").select(
        "id", F.col("old").alias("code"), F.lit(False).alias("is_new")
    ).unionAll(new.select("id", code.cast("long"), F.lit(True)))


def bond_id(atom_1: Column, atom_2: Column) -> Column:
    return F.concat_ws("_", atom_1, atom_2)


def reversed_bond_id(bond: Column) -> Column:
    p = F.split(bond, "_")
    return F.when(F.size(p) == 2, F.concat_ws("_", p[1], p[0]))
