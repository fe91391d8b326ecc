"""Queries p1, p3, p4 and p5: raw records, hot keys, profiles and references."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import profile, references, rejects, tree_agg
from gridloom.session import materialize, table


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_records(table(spark, d, "raw_record"), table(spark, d, "raw_loop"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Failing records with the first reason that holds."""
    return rejects.rejected(_parsed(spark, d)).select("record_id", "reason")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Failing records with file, line number and reason."""
    return rejects.rejected(_parsed(spark, d)).select("file_name", "line_number", "record_id", "reason")


def p1_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Typed atoms of all other rows."""
    return rejects.atoms(_parsed(spark, d))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return tree_agg.key_stats(table(spark, d, "model_atom"), ["component_id", "element"], ["occupancy", "temperature"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least 8 % of all atoms."""
    return tree_agg.heavy_keys(materialize(_states(spark, d)), 8)


def p3_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts, means and extremes for each component id and each element."""
    r = lambda c: F.round(c, 6).alias(c)
    return _states(spark, d).select(
        "column_name", "key_value", "n_rows",
        *[x for v in ("occupancy", "temperature") for x in (f"{v}_n", f"{v}_nan", r(f"{v}_mean"), f"{v}_min", f"{v}_max")]
    )


EMD_FORM = r"EMD-[0-9]{4,6}|X-RAY DIFF"


def _object_rules(spark: SparkSession, d: str) -> list[profile.ColumnRule]:
    # method_code is a fixed table of eight rows
    methods = tuple(sorted(r[0] for r in table(spark, d, "method_code").where("resolution_method is not null").distinct().collect()))
    return [
        profile.ColumnRule("map_resolution", low=0.5, high=50.0, mean_change=0.75), profile.ColumnRule("emd_id", pattern=EMD_FORM),
        profile.ColumnRule("resolution_method", domain=methods, share_change=0.25)
    ]


ATOM_RULES = [profile.ColumnRule("occupancy", low=0.0, high=1.0, mean_change=0.10)]
#: Form of the ids in pdb_id; the tables name none.
PDB_FORM = r"[0-9][0-9A-Za-z]{3}|X[0-9A-Z]{5}"
#: Share by which any other column's values must move between loads: that of resolution_method.
SHARE = 0.25


def _spans(name: str, *cuts: float) -> profile.ColumnRule:
    return profile.ColumnRule(name, cuts=cuts, share_change=SHARE)


def _codes(name: str, pattern: str | None = None) -> profile.ColumnRule:
    return profile.ColumnRule(name, pattern=pattern, buckets=16, share_change=SHARE)


#: The other columns, all but the bookkeeping of the load (row_id, load_id, loaded_at).
OBJECT_MORE = [_codes("key_tag"), _spans("atom_size", 250, 500, 1000, 2000, 4000, 8000, 16000, 32000), _codes("pdb_id", PDB_FORM)]
ATOM_MORE = [
    *[_codes(c) for c in ("key_tag", "component_id", "atom_id", "chain_id", "indicator", "element", "structure", "is_special_atom", "component_key", "atom_key")],
    _spans("serial_id", 1, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600),
    _spans("sequence_id", 0, 1, 25, 50, 75, 100, 150, 200, 400, 800),
    _spans("temperature", 0, 0.01, 10, 20, 30, 40, 50, 60, 80, 100, 150, 200, 500, 1000),
    *[_spans(f"position_{a}", *range(0, 401, 50)) for a in "xyz"],
]


def _changes(spark: SparkSession, d: str) -> DataFrame:
    work = [("model_object", [*_object_rules(spark, d), *OBJECT_MORE]), ("model_atom", [*ATOM_RULES, *ATOM_MORE])]
    with ThreadPoolExecutor(len(work)) as pool:  # the small jobs of one table run beside those of the other
        rows = [r for found in pool.map(lambda w: profile.load_changes(table(spark, d, w[0]), *w), work) for r in found]
    return spark.createDataFrame(
        [tuple(r[c.split(" ")[0]] for c in profile.CHANGE_SCHEMA.split(", ")) for r in rows], profile.CHANGE_SCHEMA
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken values, and loads in which a column is unlike the first load."""
    rules = _object_rules(spark, d)
    named = [r.name for r in rules + ATOM_RULES]
    value = profile.violations(table(spark, d, "model_object"), "model_object", rules).unionAll(
        profile.violations(table(spark, d, "model_atom"), "model_atom", ATOM_RULES)
    )
    shift = _changes(spark, d).where(F.col("shifted") & F.col("column_name").isin(named))
    return value.select(
        "table_name", "column_name", F.lit("value").alias("kind"), F.col("row_id").alias("ref_id")
    ).unionAll(shift.select("table_name", "column_name", F.lit("shift"), "load"))


def p4_load_changes(spark: SparkSession, d: str) -> DataFrame:
    """Cross-fitted discrimination and ablation of each column and load, with the exact gaps."""
    return _changes(spark, d)


def p4_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Differences of null shares, means and method shares of every later load from the first, as the comparison found them."""
    r = lambda c: F.round(c, 9).alias(c)
    methods = F.when(F.col("column_name") == "resolution_method", F.round("share_gap", 9)).alias("share_gap")
    return _changes(spark, d).select("table_name", "column_name", F.col("load").alias("load_id"), "n", r("null_gap"), r("mean_gap"), methods)


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Null, distinct and broken counts and value ranges of every column of both tables."""
    return profile.column_profile(table(spark, d, "model_object"), "model_object", [*_object_rules(spark, d), *OBJECT_MORE]).unionAll(
        profile.column_profile(table(spark, d, "model_atom"), "model_atom", [*ATOM_RULES, *ATOM_MORE])
    )


REFERENCES = [
    references.Reference("model_object", "key_tag", ("key_tag",), "object_catalog", ("key_tag",), "deleted_at"),
    references.Reference(
        "object_catalog", "key_tag", ("key_tag",), "model_object", ("key_tag",), None, "object_type = 'model'", only_missing=True
    ),
    references.Reference(
        "model_atom", "component_key", ("key_tag", "component_key"), "model_component", ("key_tag", "component_key"), "deleted_at"
    ),
    references.Reference(
        "model_component_atom", "component_key", ("key_tag", "component_key"), "model_component", ("key_tag", "component_key"), "deleted_at"
    ),
    references.Reference("model_bond", "atom_serial_id_1", ("key_tag", "atom_serial_id_1"), "model_atom", ("key_tag", "serial_id")),
    references.Reference("model_bond", "atom_serial_id_2", ("key_tag", "atom_serial_id_2"), "model_atom", ("key_tag", "serial_id")),
]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = {r.child_table for r in REFERENCES} | {r.parent_table for r in REFERENCES}
    return references.find_orphans({n: table(spark, d, n) for n in names}, REFERENCES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose target is missing, deleted or late."""
    return _orphans(spark, d).select("child_table", "child_column", "row_id", "kind")


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Their number by table, column, kind and month of arrival."""
    return references.orphans_by_month(_orphans(spark, d))


QUERIES = {
    f.__name__: f for f in (
        p1_found, p1_rejects, p1_atoms, p3_found, p3_stats, p4_found, p4_load_changes, p4_gaps, p4_profile, p5_found, p5_by_month
    )
}
