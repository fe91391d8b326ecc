"""Runs a query and its SQL over the same tables and compares rows as multisets."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings object_catalog model_object model_component model_component_atom model_atom model_bond raw_loop raw_record method_code mix_target size_setting".split()


def connection(d: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def compare(spark, d: str, query, sql: str) -> tuple[int, list, list]:
    """Rows of the query; up to five rows that only it has; up to five that only the SQL has."""
    df = query(spark, d)
    names = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    res = connection(d).execute(sql)
    cols = [x[0] for x in res.description]
    assert sorted(cols) == names, (sorted(cols), names)
    at = [cols.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    return sum(mine.values()), list((mine - theirs).elements())[:5], list((theirs - mine).elements())[:5]
