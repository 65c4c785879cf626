"""Joins of many rows with a table of one row per key, whatever share of the rows one key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: A table of up to so many rows is broadcast, after it is counted.
BROADCAST_ROWS = 50_000
#: Beyond it, the rows of a key are spread over so many tasks, and the table is repeated as often.
SALTS = 16


def join_per_key(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", broadcast_rows: int | None = None, kept: bool = False) -> DataFrame:
    """`rows` joined (inner, left or left_semi) with `table`, which holds each key once; unless it is `kept` already, the table is kept first, so that it is made once."""
    table = table if kept else cut(table)
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
