"""Which reader a file gets, by its extension in any case."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import cif, maps, pdb

MODEL_FORMATS = {".pdb": "pdb", ".cif": "cif", ".mmcif": "cif", ".mcif": "cif"}
MAP_FORMATS = (".mrc", ".map", ".ccp4")
WRITABLE_MODELS = (".pdb", ".cif")


def format_of(path: Column) -> Column:
    """pdb, cif or map by the extension of a path in any case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    out = F.when(ext.isin(list(MAP_FORMATS)), "map")
    for e, kind in MODEL_FORMATS.items():
        out = out.when(ext == e, kind)
    return out


def read_model(spark: SparkSession, path: str, model: int = 1) -> dict:
    kind = MODEL_FORMATS.get(PurePath(path).suffix.lower())
    if kind == "pdb":
        return {"atom": cif.of_model(pdb.read_atoms(spark, path), model)}
    if kind == "cif":
        return cif.read_model(spark, path, model)
    raise ValueError(f"not a structure file: {path}")


def read_map(spark: SparkSession, path: str):
    if PurePath(path).suffix.lower() not in MAP_FORMATS:
        raise ValueError(f"not a map file: {path}")
    return maps.read_map(spark, path)
