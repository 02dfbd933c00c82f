"""Patches for a per-pixel model: cutting, scoring by a given function, and voting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.functions.scalar import class_equals


def patch_dataset(pixels: DataFrame, channels: tuple[str, ...], size: int = 224, offsets: tuple[int, ...] = (0, 56, 112, 168), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, offset, py, px, and one array per channel: whole patches of each offset, row-major.

    Patches that miss a pixel, at the edges or inside, are dropped. Rasters of different keys
    (area, event) don't share patches.
    """
    placed = pixels.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).where("row >= offset and col >= offset").withColumns(
        {"py": F.floor((F.col("row") - F.col("offset")) / size).cast("int"), "px": F.floor((F.col("col") - F.col("offset")) / size).cast("int")}
    )
    cells = placed.groupBy(*keys, "offset", "py", "px").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("row", "col", *channels))).alias("cells"))
    return cells.where(F.col("n") == size * size).select(*keys, "offset", "py", "px", *[F.col(f"cells.{c}").alias(c) for c in channels])


def predict_patches(
    patches: DataFrame, channels: tuple[str, ...], scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int = 224, keys: tuple[str, ...] = ()
) -> DataFrame:
    """keys, offset, row, col, cls: classes of every pixel of every patch.

    ``scorer`` is called once per task and returns a function from an array (patches, channels,
    size, size) to classes (patches, size, size), so a model is loaded where it runs.
    """
    place, kinds = [*keys, "offset", "py", "px"], dict(patches.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for pdf in batches:
            for at in range(0, len(pdf), 8):
                part = pdf.iloc[at : at + 8]
                x = np.stack([np.array(part[c].tolist(), dtype=float) for c in channels], axis=1).reshape(len(part), len(channels), size, size)
                yield part[place].assign(classes=list(np.asarray(model(x)).reshape(len(part), -1).astype(np.int32)))

    scored = patches.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in place) + ", classes array<int>")
    cells = scored.select(*place, F.posexplode("classes").alias("k", "cls"))
    return cells.select(
        *keys,
        "offset",
        (F.col("offset") + F.col("py") * size + F.floor(F.col("k") / size)).cast("int").alias("row"),
        (F.col("offset") + F.col("px") * size + F.col("k") % size).cast("int").alias("col"),
        "cls",
    )


def vote_classes(classes: DataFrame, pixels: DataFrame | None = None, flooded: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, cls (median over offsets), flooded: whether the median is the flood class.

    A median between two classes is neither, as published. Pixels without any class are not flooded.
    """
    on = [*keys, "row", "col"]
    voted = classes.groupBy(*on).agg(F.median("cls").alias("cls"))
    if pixels is not None:
        voted = pixels.select(*on).join(voted, on, "left")
    return voted.withColumn("flooded", class_equals(F.col("cls"), flooded))
