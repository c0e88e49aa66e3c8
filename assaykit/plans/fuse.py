"""Many aggregates in one scan, returned as rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Structs of aggregates that one scan computes; wider tables take several scans rather than one huge plan.
PER_SCAN = 64


def fused(df: DataFrame, rows: Sequence[Column], by: Sequence[str] = (), per_scan: int = PER_SCAN) -> DataFrame:
    """One output row for each struct of aggregates in rows (all of one type), for each group of by."""
    parts = []
    for at in range(0, len(rows), per_scan):
        table = F.array(*rows[at : at + per_scan]).alias("__rows")
        got = df.groupBy(*by).agg(table) if by else df.agg(table)
        parts.append(got.select(*by, F.inline("__rows")))
    return reduce(DataFrame.unionByName, parts)


def row(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


def long_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), cast: str = "string", name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long: one row for each row and column, values cast to one type."""
    entries = F.array(*(F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast(cast).alias(value)) for c in cols))
    return df.select(*keep, F.inline(entries))
