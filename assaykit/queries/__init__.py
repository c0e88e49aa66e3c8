"""Registered queries of the engine's operators and the SQL they are held against."""

from __future__ import annotations

from . import analysis, engineering, modelling

QUERIES = {**analysis.QUERIES, **engineering.QUERIES, **modelling.QUERIES}
ORACLE_SQL = {**analysis.SQL, **engineering.SQL, **modelling.SQL}
