"""Columns: missing values, kinds and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, DATETIME, CATEGORICAL, NESTED = "numeric", "datetime", "categorical", "nested"


def kind_of(field: T.StructField) -> str:
    """Kind of a column from its type alone; booleans are categories."""
    if isinstance(field.dataType, T.NumericType):
        return NUMERIC
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return NESTED
    return CATEGORICAL


def columns_of(df: DataFrame, *kinds: str, but: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if kind_of(f) in kinds and f.name not in but]


def classify(df: DataFrame) -> dict[str, list[str]]:
    """Names of the columns of each kind; no job runs."""
    return {k: columns_of(df, k) for k in (NUMERIC, DATETIME, CATEGORICAL, NESTED)}


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that null is the only missing marker from here on."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(q(c)), q(c)) for c in floats}) if floats else df


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(name: str) -> Column:
    return q(name).cast("double")


def infer_task(df: DataFrame, target: str, max_classes: int = 10) -> str:
    """``classification`` for a target that is not numeric or has few distinct values, else ``regression``."""
    if kind_of(df.schema[target]) != NUMERIC:
        return "classification"
    seen = df.select(q(target)).where(q(target).isNotNull()).distinct().limit(max_classes + 1).count()
    return "classification" if seen <= max_classes else "regression"
