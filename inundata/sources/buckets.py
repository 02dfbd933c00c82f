"""Bucketed tables: what is written once by its join keys is joined and grouped by them without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def bucketed(df: DataFrame, keys: tuple[str, ...], name: str = "bucketed", buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """``df`` written to the warehouse in buckets of ``keys`` and read again.

    Rows are dealt to the buckets by one shuffle, so each bucket is one file. Tables of the same
    number of buckets and types of keys meet bucket by bucket; the default number is that of
    shuffle partitions, which users set in proportion to their input. With ``dealt`` the rows were
    made of ones that had been dealt to as many tasks by keys of these types, and aren't shuffled again.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, *keys)).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)
