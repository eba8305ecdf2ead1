"""Order-free comparison of two results by column name."""

from __future__ import annotations

import datetime as dt
import math

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    return value


def canonical(columns, rows):
    """(sorted column names, sorted rows with values in that column order)."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return names, sorted(table, key=lambda r: tuple((x is not None, str(x)) for x in r))


def odd_types(spark_types: dict[str, str], duck_types: dict[str, str]) -> list[tuple[str, str, str]]:
    return [
        (c, spark_types[c], duck_types[c])
        for c in spark_types
        if c in duck_types and KINDS.get(spark_types[c], spark_types[c]) != duck_types[c]
    ]
