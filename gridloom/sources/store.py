"""Keyed Parquet store of result tables, one partition for each key_tag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 2
#: Primary keys after key_tag, and foreign keys (columns, parent, parent columns), by table.
KEYS = {
    "object_catalog": (), "map_list": (), "model_object": (), "model_chain_map": ("entity_id", "chain_ordinal"),
    "model_component": ("component_key",), "model_component_atom": ("component_key", "atom_key"),
    "model_component_bond": ("component_key", "bond_key"),
    "model_atom": ("serial_id",), "model_bond": ("atom_serial_id_1", "atom_serial_id_2"), "model_atom_local_potential": ("serial_id",),
    "model_bond_local_potential": ("atom_serial_id_1", "atom_serial_id_2"), "model_atom_posterior": ("class_key", "serial_id"),
    "model_bond_posterior": ("class_key", "atom_serial_id_1", "atom_serial_id_2"), "model_atom_group_potential": ("class_key", "group_key"),
    "model_bond_group_potential": ("class_key", "group_key"),
}
ROOTS = {"model": "model_object", "map": "map_list"}


class Store:
    """Tables under one folder. A key is written table by table, its catalog row last, so that readers of the catalog never
    see half a key; saving again replaces the key's partitions only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/v{VERSION}/{name}"

    def table(self, name: str) -> DataFrame | None:
        if name not in KEYS:
            raise ValueError(f"no such table: {name}")
        try:
            return self.spark.read.parquet(self._at(name))
        except AnalysisException:
            return None

    def save(self, key_tag: str, tables: Mapping[str, DataFrame], object_type: str) -> None:
        """Replace everything stored under ``key_tag`` (the tables' own key_tag, if any, is renamed)."""
        if object_type not in ROOTS or ROOTS[object_type] not in tables:
            raise ValueError("object_type must be model or map, with its root table")
        unknown = set(tables) - set(KEYS)
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        order = [n for n in KEYS if n in tables and n != "object_catalog"]
        for name in [n for n in KEYS if n not in tables and n != "object_catalog"]:
            self._drop(name, key_tag)
        for name in order:
            self._write(name, tables[name].drop("key_tag").withColumn("key_tag", F.lit(key_tag)))
        self._write("object_catalog", self.spark.range(1).select(F.lit(object_type).alias("object_type"), F.lit(key_tag).alias("key_tag")))

    def save_all(self, tables: Mapping[str, DataFrame], object_type: str) -> None:
        """save() for all keys of tables that have a key_tag column, in one job a table; the catalog comes last."""
        if object_type not in ROOTS or ROOTS[object_type] not in tables or set(tables) - set(KEYS):
            raise ValueError("object_type must be model or map, with its root table, and all tables known")
        for name in [n for n in KEYS if n in tables and n != "object_catalog"]:
            self._write(name, tables[name].repartition("key_tag"))
        self._write("object_catalog", tables[ROOTS[object_type]].select(F.lit(object_type).alias("object_type"), "key_tag").distinct())

    def _write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_tag").parquet(self._at(name))

    def _drop(self, name: str, key_tag: str) -> None:
        from urllib.parse import quote

        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self._at(name)}/key_tag={quote(key_tag, safe=' .-_')}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def load(self, name: str, key_tag: str) -> DataFrame | None:
        """One key's rows: only its partition is read."""
        t = self.table(name)
        return None if t is None else t.where(F.col("key_tag") == key_tag)

    def keys(self, object_type: str | None = None) -> list[str]:
        """Stored keys in order."""
        c = self.table("object_catalog")
        if c is None:
            return []
        c = c if object_type is None else c.where(F.col("object_type") == object_type)
        return [r[0] for r in c.select("key_tag").distinct().orderBy("key_tag").collect()]

    def delete(self, key_tag: str) -> None:
        for name in KEYS:
            self._drop(name, key_tag)

    def violations(self) -> DataFrame:
        return violations(self.spark, {n: t for n in KEYS if (t := self.table(n)) is not None})

    def schema_differences(self) -> DataFrame:
        """table_name, column_name, problem: key columns that a stored table lacks. Other columns are free."""
        rows = []
        for name, keys in KEYS.items():
            t = self.table(name)
            rows += [] if t is None else [(name, c, "missing") for c in ("key_tag", *keys) if c not in t.columns]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, problem string")


def violations(spark: SparkSession, got: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, rule (primary_key, no_catalog, no_payload, no_parent), key_tag, n: everything that breaks the keys."""
    out = spark.createDataFrame([], "table_name string, rule string, key_tag string, n long")
    catalog = got.get("object_catalog")
    for name, t in got.items():
        dup = t.groupBy("key_tag", *KEYS[name]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(
            dup.groupBy("key_tag").agg(F.sum("n").alias("n")).select(
                F.lit(name).alias("table_name"), F.lit("primary_key").alias("rule"), "key_tag", "n"
            )
        )
        if name != "object_catalog" and catalog is not None:
            lost = t.join(catalog.select("key_tag"), "key_tag", "left_anti").groupBy("key_tag").agg(F.count(F.lit(1)).alias("n"))
            out = out.unionByName(lost.select(F.lit(name).alias("table_name"), F.lit("no_catalog").alias("rule"), "key_tag", "n"))
    for kind, root in ROOTS.items():
        if catalog is not None:
            c = catalog.where(F.col("object_type") == kind)
            lost = c if root not in got else c.join(got[root].select("key_tag"), "key_tag", "left_anti")
            out = out.unionByName(
                lost.groupBy("key_tag").agg(F.count(F.lit(1)).alias("n")).select(
                    F.lit("object_catalog").alias("table_name"), F.lit("no_payload").alias("rule"), "key_tag", "n"
                )
            )
    for child in ("model_bond", "model_atom_local_potential", "model_atom_posterior"):
        if child in got and "model_atom" in got:
            atoms = got["model_atom"].select("key_tag", "serial_id")
            for column in [c for c in KEYS[child] if "serial_id" in c]:
                lost = got[child].join(
                    atoms.withColumnRenamed("serial_id", column), ["key_tag", column], "left_anti"
                ).groupBy("key_tag").agg(F.count(F.lit(1)).alias("n"))
                out = out.unionByName(lost.select(F.lit(child).alias("table_name"), F.lit("no_parent").alias("rule"), "key_tag", "n"))
    return out
