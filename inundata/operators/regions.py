"""Connected regions across tiles, and morphology on them.

Tiles are labelled alone by a numpy helper; only labels that touch across a tile border meet in an
edge table, whose components are found by star rounds. So what is joined grows with perimeters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inundata.functions.kernels import label
from inundata.operators.tiles import by_tiles
from inundata.sources.folders import cut, stored

_BASE = 1 << 31


def components_of_edges(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node) of an edge table (a, b), by alternating star rounds."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct())
    raise RuntimeError("components did not settle")


def _labelled(pixels: DataFrame, diagonal: bool, tile: int, keys: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, ``more`` and local: the least code of the pixel's region within its tile.

    ``pixels`` has _of where only some are in regions; the others get numbers below 0, each its own.
    """
    some = "_of" in pixels.columns
    placed = pixels.withColumns({"row": F.col("row").cast("long"), "col": F.col("col").cast("long")}).withColumns({"ty": F.floor(F.col("row") / tile), "tx": F.floor(F.col("col") / tile)})

    def run(pdf: pd.DataFrame) -> np.ndarray:
        # tiles one below the other, with a blank line between and beside them
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        place, r, c = pdf["_tile"].to_numpy(), row % tile, col % tile
        grid = np.zeros(((int(place[-1]) + 1) * (tile + 1), tile + 1), dtype=bool)
        grid[place * (tile + 1) + r, c] = pdf["_of"].to_numpy() if some else True
        lab = label(grid, diagonal)[place * (tile + 1) + r, c] - 1
        found = (lab // (tile + 1) % (tile + 1) + row - r) * _BASE + lab % (tile + 1) + col - c
        return np.where(lab < 0, -1 - row * _BASE - col, found)

    labelled = by_tiles(placed, keys, run, "local long", tile, more=("_of",) if some else ())
    return stored(labelled.select(*keys, "row", "col", *more, "local"))


def _merged(local: DataFrame, diagonal: bool, tile: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, local, region of the labels that meet others across a tile's border: a row per label, not per pixel."""
    # pixels on a tile's last line meet those on the next tile's first line
    last = ((F.col("row") + 1) % tile == 0) | ((F.col("col") + 1) % tile == 0) | (F.col("row") % tile == 0) | (F.col("col") % tile == 0)
    ends = local.where(last).withColumn("node", F.concat_ws("|", *keys, F.lpad(F.col("local").cast("string"), 20, "0")))
    shifts = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    steps = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in shifts])
    out = ends.select(*keys, F.col("node").alias("a"), "row", "col", F.explode(steps).alias("s")).select(
        *keys, "a", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")
    )
    edges = out.join(ends.select(*keys, "row", "col", F.col("node").alias("b")), [*keys, "row", "col"]).where("a <> b").select("a", "b").distinct()
    code = F.element_at(F.split("component", r"\|"), -1).cast("long")
    return ends.select(*keys, "local", "node").distinct().join(components_of_edges(edges), "node").select(*keys, "local", code.alias("region"))


def connected_components(mask: DataFrame, diagonal: bool = False, tile: int = 128, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, region: true pixels with the least (row, col) code of their region.

    ``mask``: keys, row, col of the true pixels (row and col from 0, below 2^31). The result does
    not depend on the tile size.
    """
    local = _labelled(mask.select(*keys, "row", "col"), diagonal, tile, keys)
    merged = _merged(local, diagonal, tile, keys)
    return local.join(merged, [*keys, "local"], "left").select(*keys, "row", "col", F.coalesce("region", "local").alias("region"))


def region_sizes(regions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, region, n_pixels and bounding box; counts are partial sums, so a huge region is no burden."""
    return regions.groupBy(*keys, "region").agg(
        F.count("*").alias("n_pixels"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max")
    )


def _wide() -> Column:
    """Longer side of a region's bounding box."""
    return F.greatest(F.col("row_max") - F.col("row_min"), F.col("col_max") - F.col("col_min")) + 1


def _decided(mask: DataFrame, of: Column, keep: Column, diagonal: bool, tile: int, keys: tuple[str, ...]) -> DataFrame:
    """``mask`` (keys, row, col, flag: every pixel) and _kept: whether the pixel is in a region of ``of`` that ``keep`` holds for.

    Sizes and boxes are those of labels, of which a region has one per tile and part; pixels meet
    the labels that are kept once.
    """
    on = [*keys, "row", "col"]
    local = _labelled(mask.select(*on, "flag", F.coalesce(of, F.lit(False)).alias("_of")), diagonal, tile, keys, ("flag",))
    own = local.where("local >= 0")
    sizes = region_sizes(own.withColumnRenamed("local", "region"), keys).withColumnRenamed("region", "local")
    labels = stored(sizes.join(_merged(own, diagonal, tile, keys), [*keys, "local"], "left").withColumn("region", F.coalesce("region", "local")))
    whole = labels.groupBy(*keys, "region").agg(
        F.sum("n_pixels").alias("n_pixels"), F.min("row_min").alias("row_min"), F.max("row_max").alias("row_max"), F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max")
    )
    kept = labels.join(whole.where(keep).select(*keys, "region"), [*keys, "region"], "left_semi").select(*keys, "local", F.lit(True).alias("_kept"))
    kinds = dict(mask.dtypes)
    place = [*keys, *[F.col(c).cast(kinds[c]).alias(c) for c in ("row", "col")]]
    return local.join(kept, [*keys, "local"], "left").select(*place, "flag", F.coalesce("_kept", F.lit(False)).alias("_kept"))


def fill_small_holes(mask: DataFrame, limit: int, tile: int = 128, keys: tuple[str, ...] = ()) -> DataFrame:
    """``mask`` (keys, row, col, flag: every pixel) with background regions of fewer pixels set true."""
    return _decided(mask, ~F.col("flag"), F.col("n_pixels") < limit, False, tile, keys).select(*keys, "row", "col", (F.col("flag") | F.col("_kept")).alias("flag"))


def _opened(mask: DataFrame, keep: Column, tile: int, keys: tuple[str, ...]) -> DataFrame:
    """True pixels of the regions that ``keep`` holds for."""
    return _decided(mask, F.col("flag"), keep, True, tile, keys).select(*keys, "row", "col", F.col("_kept").alias("flag"))


def diameter_opening(mask: DataFrame, extent: int, tile: int = 128, keys: tuple[str, ...] = ()) -> DataFrame:
    """True pixels whose region's bounding box reaches ``extent`` on its longer side."""
    return _opened(mask, _wide() >= extent, tile, keys)


def remove_small_objects(mask: DataFrame, limit: float, tile: int = 128, keys: tuple[str, ...] = ()) -> DataFrame:
    """True pixels of regions with at least ``limit`` pixels."""
    return _opened(mask, F.col("n_pixels") >= limit, tile, keys)


def morphology(mask: DataFrame, unit_m2: float = 4000, pixel_m2: float = 100, tile: int = 128, keys: tuple[str, ...] = ()) -> DataFrame:
    """Holes filled, then regions of small extent and then of small area removed.

    Removing whole regions leaves the others as they are, so both tests need one labelling.
    """
    unit = unit_m2 / pixel_m2
    keep = (_wide() >= int((4 * unit / np.pi) ** 0.5)) & (F.col("n_pixels") >= unit / 2)
    return _opened(fill_small_holes(mask, int(unit), tile, keys), keep, tile, keys)


def flooded_area(areas: DataFrame, pixel_m2: float = 100.0, keys: tuple[str, ...] = ("flood_ts",)) -> DataFrame:
    """keys, km2: flooded square kilometres, two decimals. ``areas``: keys, area in pixels."""
    return areas.groupBy(*keys).agg(F.round(F.sum("area") * pixel_m2 / 1e6, 2).alias("km2"))
