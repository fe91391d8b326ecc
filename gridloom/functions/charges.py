"""Partial charges of atoms from a parameter table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.codes import structure_codes

#: Structure class of each structure code: helices, sheets, and free for all others.
STRUCTURE_CLASSES = {
    c: "HELX" if n.startswith("HELX") else "SHEET" if n in ("SHEET", "STRN") else "FREE" for n, c in structure_codes().items()
}


def partial_charges(atoms: DataFrame, table: DataFrame | None, choice: str = "partial") -> DataFrame:
    """Adds charge: 0 for ``neutral``; for ``partial`` that of (component_id, atom_id, structure class); for ``amber`` that of
    (component_id, atom_id) alone. ``table``: component_id, atom_id, structure_class, charge (null class: any). Atoms that the
    table lacks have 0. The key is the whole triple, so one structure class never stands for another."""
    if choice == "neutral" or table is None:
        return atoms.withColumn("charge", F.lit(0.0))
    if choice not in ("partial", "amber"):
        raise ValueError(f"no such choice: {choice}")
    if choice == "amber":
        t = table.where("structure_class is null").groupBy("component_id", "atom_id").agg(F.min("charge").alias("__c"))
        return atoms.join(t, ["component_id", "atom_id"], "left").withColumn("charge", F.coalesce("__c", F.lit(0.0))).drop("__c")
    pairs = F.create_map(*[F.lit(x) for kv in STRUCTURE_CLASSES.items() for x in kv])
    t = table.where("structure_class is not null").groupBy(
        "component_id", "atom_id", F.col("structure_class").alias("__s")
    ).agg(F.min("charge").alias("__c"))
    a = atoms.withColumn("__s", F.coalesce(F.try_element_at(pairs, F.col("structure")), F.lit("FREE")))
    return a.join(t, ["component_id", "atom_id", "__s"], "left").withColumn("charge", F.coalesce("__c", F.lit(0.0))).drop("__c", "__s")
