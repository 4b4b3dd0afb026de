"""Registry of named queries (Spark DataFrame builders) and their SQL oracles.

Each query takes ``(spark, sf_dir)``, reads the test tables, and returns a
DataFrame whose double columns are rounded to ``DIGITS`` places so that an
independent engine's result can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double/float column (and turn NaN into null).

    The projection is SQL text in one ``selectExpr`` (one JVM call however
    wide the table is)."""
    cols = []
    for f in df.schema.fields:
        name = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = f"CAST({name} AS DOUBLE)"
            cols.append(f"round(nanvl({c}, CAST(NULL AS DOUBLE)), {int(digits)}) + 0.0D AS {name}")
        else:
            cols.append(name)
    return df.selectExpr(*cols)


def round_sql(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of ``rounded``: Spark rounds a double HALF_UP on its shortest
    decimal representation, so the oracle does the same (double -> shortest
    string -> DECIMAL -> round -> double) instead of rounding the binary value."""
    x = f"CAST({expr} AS DOUBLE)"
    dec = f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"
    # huge or non-finite values skip the decimal path (DECIMAL(38, 18) holds < 1e20)
    return f"(CASE WHEN isfinite({x}) AND abs({x}) < 1e15 THEN {dec} ELSE round({x}, {digits}) END + 0.0)"
