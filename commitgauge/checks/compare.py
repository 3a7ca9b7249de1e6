"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return repr(value)


def _rows(names, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    """What differs between both results; empty when they agree."""
    df = query(spark, sf_dir)
    names, rows = _rows(df.columns, df.collect())
    result = con.sql(sql)
    oracle_names, oracle_rows = _rows(list(result.columns), result.fetchall())
    if names != oracle_names:
        return [f"columns {names} and {oracle_names}"]
    if len(rows) != len(oracle_rows):
        found = [f"{len(rows)} and {len(oracle_rows)} rows"]
    else:
        found = []
    ours, theirs = set(rows) - set(oracle_rows), set(oracle_rows) - set(rows)
    for side, extra in (("query only", ours), ("SQL only", theirs)):
        found += [f"{side}: {len(extra)} rows, first {str(dict(zip(names, min(extra))))[:700]}"] if extra else []
    return found
