"""What a key (area, event) has once, brought to its many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_key_rows(df: DataFrame, rows: DataFrame, keys: tuple[str, ...] | list[str], how: str = "inner") -> DataFrame:
    """``df`` joined to ``rows``, one or a few per key (without keys, of the whole table).

    A key is a raster and may have every pixel there is. A join dealt by keys would sort all of them
    in one task, so the few rows go to the many: they are broadcast, and pixels stay where they are.
    """
    return df.join(F.broadcast(rows), list(keys), how) if keys else df.crossJoin(F.broadcast(rows))
