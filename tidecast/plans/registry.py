"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or frames Spark derives from them) in
full.  Double outputs are emitted at single precision (``float``, seven
significant digits) here, and in the matching oracle SQL, so that the
different summation orders of two engines cannot flip a value hash; the
library functions themselves return doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB oracle (None: not SQL-expressible)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def comparable(df: DataFrame) -> DataFrame:
    """Doubles -> float (relative rounding); dates and timestamps -> ISO strings."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = c.cast("float")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)
