"""Joins of many rows with a small keyed table, safe against a key that holds a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a hot key's rows go to so many places
SALTS = 32


def join(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: Column, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row per key. Rows are dealt by `by` over SALTS places of
    their key and the table's rows stand in all of them; Spark sends the table round instead where its
    size is under the broadcast threshold."""
    placed = rows.withColumn("__salt", F.pmod(by, F.lit(SALTS)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return placed.join(copies, [*keys, "__salt"], how).drop("__salt")
