"""Rows of a Spark query and of its SQL, in a comparable form."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def _value(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(map(_value, r)) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def types(c, sql: str) -> dict[str, str]:
    return {k: str(v) for k, v in c.execute(f"DESCRIBE {sql}").df()[["column_name", "column_type"]].values}
