"""Rasters in long form (row, col, value): clipping, regridding, coarsening, slope, mosaics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inundata.functions.scalar import in_ring, ring_bounds, ring_sides
from inundata.operators import halo
from inundata.sources.buckets import bucketed


def pixel_table(pixels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pixels (keys, row, col, ...) written in buckets of their place.

    Tables of this kind are joined by (keys, row, col), and grouped by them, without a shuffle; row
    and col become ``int``, as buckets of other types don't meet.
    """
    return bucketed(pixels.withColumns({c: F.col(c).cast("int") for c in ("row", "col")}), (*keys, "row", "col"), "pixels")


def clip_to_bounds(pixels: DataFrame, lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> DataFrame:
    """Pixels whose centre (x, y) is in a box; the comparison reaches the scan."""
    return pixels.where(F.col("x").between(lon_min, lon_max) & F.col("y").between(lat_min, lat_max))


def clip_to_ring(pixels: DataFrame, ring: Column) -> DataFrame:
    box = ring_bounds(ring)
    near = F.col("x").between(box["lon_min"], box["lon_max"]) & F.col("y").between(box["lat_min"], box["lat_max"])
    return pixels.where(near & in_ring(F.col("x"), F.col("y"), ring))


def drop_empty_lines(pixels: DataFrame, value: str) -> DataFrame:
    """Pixels of rows and columns that hold any valid value."""
    valid = pixels.where(F.col(value).isNotNull())
    return pixels.join(valid.select("row").distinct(), "row", "left_semi").join(valid.select("col").distinct(), "col", "left_semi")


def axis_vectors(pixels: DataFrame) -> DataFrame:
    """axis, place, mean: latitude per row and longitude per column, over valid pixels."""
    return (
        pixels.groupBy(F.col("row").alias("place"))
        .agg(F.avg("lat").alias("mean"))
        .withColumn("axis", F.lit("row"))
        .unionByName(pixels.groupBy(F.col("col").alias("place")).agg(F.avg("lon").alias("mean")).withColumn("axis", F.lit("col")))
    )


def coarsen_max(pixels: DataFrame, value: str, size: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, crow, ccol, value: maxima of size x size blocks; edge blocks have what is there."""
    block = lambda p, name: F.floor(F.col(p) / size).cast("int").alias(name)
    return pixels.groupBy(*keys, block("row", "crow"), block("col", "ccol")).agg(F.max(value).alias(value))


def slope(dem: DataFrame, cell_x: float, cell_y: float, value: str = "dem", tile: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, slope: 3 x 3 Horn slope in degrees; NULL where a neighbour is missing.

    Each chip takes one line of cells from its neighbours. Cells without a value have no row.
    """
    kinds = dict(dem.dtypes)

    def horn(own: dict, r0: int, c0: int, grids: dict[str, np.ndarray]) -> pd.DataFrame:
        z = grids["z"]
        along, across = z[:, 2:] - z[:, :-2], z[2:] - z[:-2]
        gx = along[:-2] + 2 * along[1:-1] + along[2:]
        gy = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]
        rise = np.hypot(gx / (8 * cell_x), gy / (8 * cell_y))
        degrees = np.full(z.shape, np.nan)
        degrees[1:-1, 1:-1] = np.where(np.isnan(z[1:-1, 1:-1]), np.nan, np.degrees(np.arctan(rise)))
        inner = np.zeros(z.shape, dtype=bool)
        inner[1:-1, 1:-1] = ~np.isnan(z[1:-1, 1:-1])
        return halo.cells(own, keys, np.nonzero(inner), r0, c0, slope=degrees)

    chips_ = halo.to_chips(dem.select(*keys, "row", "col", F.col(value).alias("z")).where("z is not null"), tile, ("z",), keys=keys)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + f"row {kinds['row']}, col {kinds['col']}, slope double"
    found = halo.with_halo(chips_, 1, horn, schema)
    return found.withColumn("slope", F.nanvl("slope", F.lit(None).cast("double")))


def slope_mask(pixels: DataFrame, cell_x: float, cell_y: float, limit: float = 10.0, size: int = 6, value: str = "dem", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, slope, slope_mask: slope of the coarse grid, brought back to each pixel."""
    coarse = coarsen_max(pixels, value, size, keys).withColumnsRenamed({"crow": "row", "ccol": "col"})
    s = slope(coarse, cell_x * size, cell_y * size, value, keys=keys).withColumnsRenamed({"row": "crow", "col": "ccol"})
    placed = pixels.withColumns({"crow": F.floor(F.col("row") / size).cast("int"), "ccol": F.floor(F.col("col") / size).cast("int")})
    return placed.join(s, [*keys, "crow", "ccol"], "left").select(*keys, "row", "col", "slope", F.coalesce(F.col("slope") < limit, F.lit(False)).alias("slope_mask"))


def resample_nearest(source: DataFrame, target: DataFrame, x0: float, y0: float, dx: float, dy: float, value: str = "v") -> DataFrame:
    """The target's columns and the value of the source cell whose centre is nearest."""
    row = F.floor((F.col("y") - y0) / dy + 0.5).cast("int")
    col = F.floor((F.col("x") - x0) / dx + 0.5).cast("int")
    placed = target.withColumns({"_r": row, "_c": col})
    return placed.join(source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value), ["_r", "_c"], "left").drop("_r", "_c")


def resample_bilinear(source: DataFrame, target: DataFrame, x0: float, y0: float, dx: float, dy: float, value: str = "v", nodata: float = -9999.0) -> DataFrame:
    """row, col, value of the target: weights of the four cells around, over those that are valid."""
    fy, fx = (F.col("y") - y0) / dy, (F.col("x") - x0) / dx
    around = target.select(
        "row", "col", fx.alias("fx"), fy.alias("fy"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k")
    ).withColumns({"_r": (F.floor("fy") + F.col("k.a")).cast("int"), "_c": (F.floor("fx") + F.col("k.b")).cast("int")})
    weight = (1 - F.abs(F.col("fy") - F.col("_r"))) * (1 - F.abs(F.col("fx") - F.col("_c")))
    met = around.withColumn("w", weight).where("w > 0").join(source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("v")), ["_r", "_c"], "left")
    sums = met.groupBy("row", "col").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("w") * F.col("v"))).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("w"))
    return sums.select("row", "col", F.coalesce(F.try_divide("s", "w"), F.lit(nodata)).alias(value))


def mosaic_tiles(tiles: DataFrame, value: str = "value", rank: str = "tile", nodata: float | None = None) -> DataFrame:
    """row, col, value: the first tile that has a value wins."""
    valid = tiles.where(F.col(value).isNotNull() & (F.lit(True) if nodata is None else F.col(value) != nodata))
    return valid.groupBy("row", "col").agg(F.min_by(value, rank).alias(value))


def pixel_runs(shapes: DataFrame, rings: Column, x0: float, y0: float, dx: float, dy: float, extent: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep, row, c0, c1: the runs of pixels (both ends included) whose centres lie in each shape.

    ``rings``: arrays of struct(lon, lat), open or closed; the even-odd rule over all of them, so
    holes are rings like any other. Pixel (row, col) has its centre at (x0 + col dx, y0 + row dy).
    ``extent``: one row (r0, r1, c0, c1), the part of the grid that is wanted. Each side of a ring
    becomes one crossing per raster row that it passes, and the sorted crossings of a shape and row
    pair up into runs; so the cost goes by sides and rows, not by corners times pixels. ``keep``
    names each shape; rows that agree in it and in their rings are one shape.
    """
    one = shapes.select(*keep, rings.alias("_rings")).withColumn("_h", F.xxhash64("_rings")).dropDuplicates([*keep, "_h"])
    sides = one.select(*keep, "_h", F.explode(F.flatten(F.transform("_rings", ring_sides))).alias("e")).where("e.a.lat <> e.b.lat")
    low, high = (F.least("e.a.lat", "e.b.lat") - y0) / dy, (F.greatest("e.a.lat", "e.b.lat") - y0) / dy
    # rows whose centre is at or above the lower end and below the upper one
    first, last = (F.ceil(low), F.ceil(high) - 1) if dy > 0 else (F.floor(high) + 1, F.floor(low))
    spans = sides.crossJoin(F.broadcast(extent)).withColumns({"a": F.greatest(first, F.col("r0")).cast("int"), "b": F.least(last, F.col("r1")).cast("int")})  # one row
    crossed = spans.where("a <= b").withColumn("row", F.explode(F.sequence("a", "b")))
    y = y0 + F.col("row") * dy
    x = (F.col("e.b.lon") - F.col("e.a.lon")) * (y - F.col("e.a.lat")) / (F.col("e.b.lat") - F.col("e.a.lat")) + F.col("e.a.lon")
    lines = crossed.withColumn("x", x).groupBy(*keep, "_h", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.first("c0").alias("_c0"), F.first("c1").alias("_c1"))
    pairs = lines.select(*keep, "row", "_c0", "_c1", "xs", F.explode(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1)).alias("i"))
    left, right = (F.get("xs", 2 * F.col("i")) - x0) / dx, (F.get("xs", 2 * F.col("i") + 1) - x0) / dx
    c0, c1 = (F.ceil(left), F.ceil(right) - 1) if dx > 0 else (F.floor(right) + 1, F.floor(left))
    return pairs.select(*keep, "row", F.greatest(c0, F.col("_c0")).cast("int").alias("c0"), F.least(c1, F.col("_c1")).cast("int").alias("c1")).where("c0 <= c1")


def grid_extent(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


def rasterize_polygons(grid: DataFrame, polygons: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """row, col, attr: attribute of the last polygon whose ring holds the pixel centre.

    ``polygons``: place (order), attr, ring; of equal places the larger attribute wins. The grid is
    not copied; what meets it is one row per burnt pixel.
    """
    runs = pixel_runs(polygons, F.array("ring"), x0, y0, dx, dy, grid_extent(grid), ("place", "attr"))
    hit = runs.select("place", "attr", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    burnt = hit.groupBy("row", "col").agg(F.max(F.struct("place", "attr"))["attr"].alias("attr"))
    return grid.select("row", "col").join(burnt, ["row", "col"], "left")


def clip_to_area(pixels: DataFrame, area: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Pixels (row, col, ...) whose centre lies in any polygon of ``area`` (ring), by runs per row."""
    runs = pixel_runs(area, F.array("ring"), x0, y0, dx, dy, grid_extent(pixels), ()).select(F.col("row").alias("_row"), "c0", "c1")
    return pixels.join(runs, (F.col("row") == F.col("_row")) & F.col("col").between(F.col("c0"), F.col("c1")), "left_semi")


def tiles_for_aoi(tiles: DataFrame, bounds: Column) -> DataFrame:
    """Tiles (tile, lon_min, lat_min, lon_max, lat_max) whose box meets the area's."""
    return tiles.where(
        (F.col("lon_min") <= bounds["lon_max"]) & (bounds["lon_min"] <= F.col("lon_max")) & (F.col("lat_min") <= bounds["lat_max"]) & (bounds["lat_min"] <= F.col("lat_max"))
    )


def raster_rows(pixels: DataFrame, value: str = "v") -> DataFrame:
    """row, values: one array per raster row, in column order."""
    return pixels.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", value))), lambda x: x[value]).alias("values"))


def whole_chips(pixels: DataFrame, value: str, size: int) -> DataFrame:
    """cy, cx, values: size x size squares in row-major order, NULL where there is no pixel.

    Of several pixels of one place the largest value counts. Blank places are put in chip by chip,
    so no task makes the places of more than one.
    """
    at = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int")
    blank = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.struct(k.alias("k"), F.lit(None).cast(dict(pixels.dtypes)[value]).alias("v")))
    met = pixels.groupBy(F.floor(F.col("row") / size).cast("int").alias("cy"), F.floor(F.col("col") / size).cast("int").alias("cx")).agg(F.collect_list(F.struct(at.alias("k"), F.col(value).alias("v"))).alias("cells"))
    # blanks come first at their place, the largest value last
    full = met.select("cy", "cx", F.array_sort(F.concat("cells", blank)).alias("cells"))
    last = F.filter("cells", lambda x, i: F.coalesce(F.get("cells", i + 1)["k"] != x["k"], F.lit(True)))
    return full.select("cy", "cx", F.transform(last, lambda x: x["v"]).alias("values"))


def chips(pixels: DataFrame, value: str, size: int) -> DataFrame:
    """cy, cx, cells: the pixels of size x size squares, in row-major order."""
    return pixels.groupBy(F.floor(F.col("row") / size).cast("int").alias("cy"), F.floor(F.col("col") / size).cast("int").alias("cx")).agg(
        F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).alias("v")))).alias("cells")
    )


def chip_pixels(chip: DataFrame) -> DataFrame:
    """Chips with ``values`` in row-major order (cy, cx, row0, col0, h, w, values) as row, col, value."""
    return chip.select("row0", "col0", "w", F.posexplode("values").alias("k", "value")).select(
        (F.col("row0") + F.floor(F.col("k") / F.col("w"))).cast("int").alias("row"), (F.col("col0") + F.col("k") % F.col("w")).cast("int").alias("col"), "value"
    )


def last_times(stack: DataFrame, n: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the last n times of their keys, with ``back`` = 1 for the last."""
    times = stack.select(*keys, "time").distinct()
    ranked = times.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("time").desc()))).where(F.col("back") <= n)
    return stack.join(ranked, [*keys, "time"])


def landcover_classes(cover: DataFrame, names: dict[int, str]) -> DataFrame:
    """code, n, name."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return cover.groupBy("code").agg(F.count("*").alias("n")).withColumn("name", F.try_element_at(table, F.col("code")))


def landcover_of_flood(cover: DataFrame, flood: DataFrame) -> DataFrame:
    """code, n: flooded pixels (row, col) of each land cover (row, col, code)."""
    return cover.join(flood.select("row", "col"), ["row", "col"]).groupBy("code").agg(F.count("*").alias("n"))
