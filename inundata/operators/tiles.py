"""Work on the tiles of a raster, many at a time.

Pixels are dealt and sorted by tile; a task takes the whole tiles of a batch together, so the fixed
cost of a call is paid per batch and not per tile, of which sparse rasters have many small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def dealt(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pixels (keys, ty, tx, ...) with each tile in one task. Tiles are small in bytes and long in work, so tasks aren't merged by bytes."""
    return pixels.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "ty", "tx")


def whole_tiles(batches: Iterator[pa.RecordBatch], marks: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``marks`` in tables that end where a tile does, with the number of each row's tile, counted from 0."""

    def numbered(table: pa.Table) -> np.ndarray:
        """NULL keys are equal."""
        fresh = np.zeros(len(table), dtype=bool)
        for m in marks:
            code = pc.dictionary_encode(table[m].combine_chunks(), null_encoding="encode")
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
            fresh[1:] |= code[1:] != code[:-1]
        return np.cumsum(fresh)

    left: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        left.append(pa.Table.from_batches([batch]))
        table = pa.concat_tables(left)
        at = numbered(table)
        # the last tile may go on in the next batch
        whole = int(np.searchsorted(at, at[-1]))
        if whole:
            yield table.slice(0, whole), at[:whole]
            left = [table.slice(whole)]
    if left:
        table = pa.concat_tables(left)
        yield table, numbered(table)


def in_steps(at: np.ndarray, step: int) -> list[tuple[int, int]]:
    """First and last row + 1 of each ``step`` tiles, for the tiles' numbers in order."""
    ends = np.searchsorted(at, [*range(step, int(at[-1]) + 1, step), int(at[-1]) + 1]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def by_tiles(pixels: DataFrame, keys: tuple[str, ...], work: Callable[[pd.DataFrame], np.ndarray], column: str, tile: int, cells: int = 100_000, more: tuple[str, ...] = ()) -> DataFrame:
    """``pixels`` (keys, row, col, ty, tx) and a long ``column`` ("name long"): what ``work`` gives for each pixel.

    ``work`` takes row, col, ``more`` columns and _tile of some whole tiles, as many as ``cells``
    allows: the tile's number in this call, ascending from 0.
    """
    marks, name = [*keys, "ty", "tx"], column.split()[0]
    step = max(1, cells // (tile + 1) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_tiles(batches, marks):
            pdf = pd.DataFrame({c: table[c].to_numpy() for c in ("row", "col", *more)} | {"_tile": at})
            found = [work(pdf[a:b].assign(_tile=at[a:b] - at[a])) for a, b in in_steps(at, step)]
            yield from table.append_column(name, pa.array(np.concatenate(found), pa.int64())).combine_chunks().to_batches()

    schema = StructType.fromJson(pixels.schema.jsonValue()).add(name, column.split()[1])
    return dealt(pixels, keys).sortWithinPartitions(*marks).mapInArrow(run, schema)
