"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6
#: Moves values off the middle between two roundings, which engines resolve differently.
NUDGE = 1e-10


def finish(df: DataFrame) -> DataFrame:
    """Rounds doubles (sums depend on the order of rows) and takes the zone off timestamps."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append((F.round(F.col(name) + NUDGE, DIGITS) + 0.0).alias(name))
        elif kind == "timestamp":
            out.append(F.col(name).cast("timestamp_ntz").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Registers a function (spark, sf_dir) -> DataFrame; ``doubles`` are rounded in the SQL as well."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        if sql is not None:
            rounded = ", ".join(f"round({c} + {NUDGE}, {DIGITS}) + 0.0 AS {c}" for c in doubles)
            head, body = split_with(sql)
            SQL[name] = f"{head}SELECT * REPLACE ({rounded}) FROM ({body})" if doubles else f"{head}{body}"
        return fn

    return register


def split_with(sql: str) -> tuple[str, str]:
    """(WITH clause, final SELECT): fragments mark the border with '---'."""
    head, mark, body = sql.rpartition("---")
    return (head, body) if mark else ("", sql)
