"""Fixed-width structure files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions.strings import float_prefix, int_prefix


def read_atoms(spark: SparkSession, paths: str | list[str], model: int | None = None) -> DataFrame:
    """Atoms of all files (or of one model number), as parse_lines() gives them."""
    text = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r\n|\n|\r"))
    )
    a = parse_lines(text.withColumnsRenamed({"pos": "line_number", "col": "t"}))
    return a if model is None else a.where(F.col("model_number") == model)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Atoms of lines (path, line_number, t): ATOM and HETATM lines by position; the model number counts ENDMDL lines.

    Component keys are derived from names downstream, as for the other format. Lines without name or coordinates are dropped.
    """
    ends = F.coalesce(
        F.sum(F.when(F.col("t").startswith("ENDMDL"), 1).otherwise(0)).over(
            W.partitionBy("path").orderBy("line_number").rowsBetween(W.unboundedPreceding, -1)
        ),
        F.lit(0)
    ) + 1
    cut = lambda a, n: F.trim(F.substring("t", a, n))
    a = lines.withColumn("model_number", ends.cast("int")).where(F.substring("t", 1, 6).isin("ATOM  ", "HETATM"))
    return a.select(
        "path", "line_number", "model_number", (F.substring("t", 1, 6) == "HETATM").alias("is_special_atom"),
        int_prefix(cut(7, 5)).alias("serial_id"), cut(13, 4).alias("atom_id"),
        F.when(cut(17, 1) == "", ".").otherwise(cut(17, 1)).alias("indicator"), cut(18, 3).alias("component_id"),
        cut(22, 1).alias("chain_id"),
        F.coalesce(int_prefix(cut(23, 4)), F.lit(-1)).alias("sequence_id"), float_prefix(cut(31, 8)).alias("x"),
        float_prefix(cut(39, 8)).alias("y"), float_prefix(cut(47, 8)).alias("z"),
        F.coalesce(float_prefix(cut(55, 6)), F.lit(1.0)).alias("occupancy"),
        F.coalesce(float_prefix(cut(61, 6)), F.lit(0.0)).alias("temperature"), cut(73, 4).alias("segment_id"), cut(77, 2).alias("element"),
    ).where("atom_id <> '' and x is not null and y is not null and z is not null")
