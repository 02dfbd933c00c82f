"""The three whole workloads: statistical flood map, patch-model map, scene selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.functions import scalar
from inundata.operators import catalogue, delineate, orbits, patches, raster, regions, stats
from inundata.plans import views as v
from inundata.plans.queries import OTSU, SLOPE, TRIMMED
from inundata.plans.registry import register
from inundata.sources.folders import cut


def mask_and(scores: DataFrame, threshold: DataFrame, slopes: DataFrame) -> DataFrame:
    """``scores`` with global (below the threshold), slope_mask, and global_masked, which needs both.

    ``threshold``: one row. ``slopes``: row, col, slope_mask; pixels without one are not in the mask,
    and missing scores are not below anything.
    """
    dark, flat = scalar.below(F.col("t"), F.col("threshold")), F.coalesce("slope_mask", F.lit(False))
    met = scores.crossJoin(F.broadcast(threshold)).join(slopes.select("row", "col", "slope_mask"), ["row", "col"], "left")  # one row
    return met.select(*scores.columns, dark.alias("global"), flat.alias("slope_mask"), (dark & flat).alias("global_masked"))


def statistical_flood_map(
    stack: DataFrame, static: DataFrame, p: delineate.FloodParams = delineate.FloodParams(), cell_x: float = 10.0, cell_y: float = 10.0, slope_limit: float = 10.0
) -> DataFrame:
    """row, col and a column per layer, from backscatter to the cleaned flood map.

    ``stack``: time, row, col, vv_vh_db. ``static``: row, col, lia, dem. The last time is the flood
    image. Layers that later ones read more than once are written: in buckets of their pixels, so
    that stack, static fields and layers are joined and grouped by pixel without a shuffle.
    """
    on = ["row", "col"]
    stack, static = raster.pixel_table(stack), raster.pixel_table(static)
    scores = raster.pixel_table(stats.t_scores(stats.weighted_stack(stack, static)))
    mask = raster.pixel_table(delineate.bimodality_mask(scores, p).withColumnRenamed("mask", "multimodality_mask"))
    bimodal = scores.join(mask.where("multimodality_mask"), on, "left_semi")
    threshold = stats.otsu_threshold(stats.quantile_trim(bimodal, "t", 0.01, 0.99), "t", kept=True)
    slopes = raster.slope_mask(static, cell_x, cell_y, slope_limit).select("row", "col", "slope_mask")
    layers = raster.pixel_table(mask_and(scores.join(mask, on), threshold, slopes))
    water = stats.water_stats(layers, "global_masked", kept=True).first()
    mean, std = water["mean"] or 0.0, water["std"] or 0.0
    local = delineate.adaptive_threshold(scores, layers.select("row", "col", F.col("global").alias("mask")), mean, std, p)
    local = raster.pixel_table(local.select("row", "col", F.col("flooded").alias("local")))
    grown = delineate.region_growing(scores, local.withColumnRenamed("local", "mask"), strict_edges=p.strict_edges).withColumnRenamed("flooded", "grown")
    level = cut(layers.join(local, on).join(grown, on))
    cleaned = regions.morphology(level.select("row", "col", (F.col("grown") & F.col("slope_mask")).alias("flag")), p.unit_m2, p.pixel_m2, p.tile)
    return level.join(cleaned.withColumnRenamed("flag", "flooded"), on)


def patch_flood_map(
    stack: DataFrame, scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int = 224, offsets: tuple[int, ...] = (0, 56, 112, 168), keys: tuple[str, ...] = ()
) -> DataFrame:
    """keys, row, col, cls, flooded by a per-pixel model on the last three images' normalised bands.

    ``stack``: keys, time, row, col, vv_db, vh_db; each key has its own last images. Channels: VV and VH of the flood image, then of the
    two images before it.
    """
    last = raster.last_times(stack, 3, keys)
    channels = tuple(f"{band}_{k}" for k in (1, 2, 3) for band in ("vv", "vh"))
    at = lambda band, k, i: scalar.model_normalise(scalar.from_db(F.max(F.when(F.col("back") == k, F.col(f"{band}_db")))), i)
    pixels = last.groupBy(*keys, "row", "col").agg(*[at(band, k, i).alias(f"{band}_{k}") for k in (1, 2, 3) for i, band in enumerate(("vv", "vh"))])
    pixels = cut(pixels)
    classes = patches.predict_patches(patches.patch_dataset(pixels, channels, size, offsets, keys), channels, scorer, size, keys)
    return patches.vote_classes(classes, pixels, keys=keys)


def scene_selection(products: DataFrame, files: DataFrame, chosen: DataFrame) -> DataFrame:
    """scene_id, filename, orbit_type: orbit files of the products of a chosen pass.

    ``products``: Id, mission, begin, stop, orbitDirection, relativeOrbitNumber, PublicationDate.
    """
    kept = catalogue.latest_product(products, "begin", "PublicationDate", "Id", ("orbitDirection", "relativeOrbitNumber"))
    same = catalogue.same_pass_products(kept, chosen)
    return orbits.orbit_with_fallback(same.select(F.col("Id").alias("scene_id"), "mission", F.col("begin").alias("start"), "stop"), files)


@register(f"""WITH {TRIMMED}, {OTSU}, g AS (SELECT row // 6 AS row, col // 6 AS col, max(dem) AS z FROM static GROUP BY 1, 2), {SLOPE.replace("CX", "60e0").replace("CY", "60e0")},
  b AS (SELECT s.row, s.col, coalesce(t < threshold, false) AS dark, coalesce(slope < 60, false) AND d.row IS NOT NULL AS flat
    FROM otsu, scores s LEFT JOIN static d ON s.row = d.row AND s.col = d.col LEFT JOIN slope p ON s.row // 6 = p.row AND s.col // 6 = p.col)
  SELECT row, col, dark AS "global", flat AS slope_mask, dark AND flat AS global_masked FROM b""")
def global_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Global threshold and slope mask multiplied, pixel by pixel, in tables by pixel."""
    fields = raster.pixel_table(v.static(spark, sf))
    scores = raster.pixel_table(stats.t_scores(stats.weighted_stack(raster.pixel_table(v.stack(spark, sf)), fields)))
    threshold = stats.otsu_threshold(stats.quantile_trim(scores, "t", 0.01, 0.99, kept=True), "t", kept=True)
    return mask_and(scores, threshold, raster.slope_mask(fields, 10.0, 10.0, 60.0)).select("row", "col", "global", "slope_mask", "global_masked")


@register()
def flood_map(spark: SparkSession, sf: str) -> DataFrame:
    """All layers on the stack view: its parts have SQL twins or brute-force tests of their own."""
    p = delineate.FloodParams(sizes=(10, 20, 25), bimodality=0.4, least_pixels=50, smoothing=False, halves=(8, 12), local_bimodality=0.45, unit_m2=900, tile=64)
    layers = statistical_flood_map(v.stack(spark, sf), v.static(spark, sf), p, slope_limit=89.0)
    return layers.select("row", "col", F.round("t", 5).alias("t"), "multimodality_mask", "global", "slope_mask", "global_masked", "local", "grown", "flooded")


def _dark_scorer() -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in for a model: class 2 where the flood image is darker than both before."""
    return lambda x: np.where((x[:, 0] < x[:, 2]) & (x[:, 0] < x[:, 4]), 2, 0)


@register(f"""WITH {v.STACK}, n AS (SELECT row, col, greatest(0e0, least(0.15e0, coalesce(max(CASE WHEN time = 7 THEN vv END), 0.15e0))) AS a, greatest(0e0, least(0.15e0, coalesce(max(CASE WHEN time = 6 THEN vv END), 0.15e0))) AS b,
    greatest(0e0, least(0.15e0, coalesce(max(CASE WHEN time = 5 THEN vv END), 0.15e0))) AS c FROM stack WHERE time >= 5 GROUP BY 1, 2),
  k AS (SELECT row, col, CASE WHEN a < b - 1e-12 AND a < c - 1e-12 THEN 2 ELSE 0 END AS cls, o, count(*) OVER (PARTITION BY o, (row - o) // 2, (col - o) // 2) AS m FROM n, (SELECT unnest([0, 1]) AS o) WHERE row >= o AND col >= o),
  w AS (SELECT row, col, median(cls) AS cls FROM k WHERE m = 4 GROUP BY 1, 2) SELECT n.row, n.col, coalesce(w.cls = 2, false) AS flooded FROM n LEFT JOIN w ON n.row = w.row AND n.col = w.col""")
def patch_map(spark: SparkSession, sf: str) -> DataFrame:
    return patch_flood_map(v.stack(spark, sf), _dark_scorer, 2, (0, 1)).select("row", "col", "flooded")


T0 = "INTERVAL 5984571 MILLISECONDS"
MATCH = "row_number() OVER (PARTITION BY scene_id ORDER BY created DESC, filename DESC) AS i FROM s JOIN orbits o ON s.mission = o.mission AND o.stop >= s.start + INTERVAL 325 SECONDS AND o.start <= s.start -"


@register(f"""WITH {v.PRODUCTS}, {v.ORBITS}, k AS (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY direction, rel, begin ORDER BY published DESC, id) = 1),
  s AS (SELECT id AS scene_id, CASE WHEN id % 2 = 0 THEN 'S1A' ELSE 'S1B' END AS mission, begin - INTERVAL 9500 DAYS AS start FROM k WHERE (direction, rel) IN (SELECT direction, rel FROM products ORDER BY begin DESC, id DESC LIMIT 1)),
  a AS (SELECT scene_id, filename, {MATCH} {T0} WHERE orbit_type = 'precise'), b AS (SELECT scene_id, filename, {MATCH} INTERVAL 60 SECONDS WHERE orbit_type = 'restituted')
  SELECT s.scene_id, coalesce(a.filename, b.filename) AS filename, CASE WHEN a.filename IS NOT NULL THEN 'precise' WHEN b.filename IS NOT NULL THEN 'restituted' END AS orbit_type
  FROM s LEFT JOIN (SELECT * FROM a WHERE i = 1) a ON s.scene_id = a.scene_id LEFT JOIN (SELECT * FROM b WHERE i = 1) b ON s.scene_id = b.scene_id""")
def scene_orbits(spark: SparkSession, sf: str) -> DataFrame:
    """Orbit files of one pass's products, moved back to the years of the test tables' orbits."""
    p = catalogue.catalogue_attributes(v.products(spark, sf), ("orbitDirection", "relativeOrbitNumber", "beginningDateTime"))
    p = p.withColumn("begin", F.try_to_timestamp("beginningDateTime") - F.expr("INTERVAL 9500 DAYS")).withColumn("stop", F.col("begin") + F.expr("INTERVAL 25 SECONDS"))
    p = p.withColumn("mission", F.when(F.col("Id") % 2 == 0, "S1A").otherwise("S1B"))
    chosen = p.orderBy(F.col("begin").desc(), F.col("Id").desc()).limit(1)
    return scene_selection(p, v.orbits(spark, sf), chosen)


@register(f"WITH {v.PRODUCTS} SELECT id, CAST(lon AS DOUBLE) AS lon_min, CAST(lat + 2 AS DOUBLE) AS lat_max, round(lon + 1e0, 6) AS lon, round(lat + 1e0, 6) AS lat FROM products")
def aoi_bounds_centroid(spark: SparkSession, sf: str) -> DataFrame:
    ring = scalar.outer_ring(F.col("GeoFootprint.coordinates"))
    p = v.products(spark, sf).select(F.col("Id").alias("id"), scalar.ring_bounds(ring).alias("b"), scalar.ring_centroid(ring).alias("c"))
    return p.select("id", "b.lon_min", "b.lat_max", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@register(f"WITH {v.STACK}, f AS (SELECT row, col FROM stack WHERE time = 7 AND vv < 0.3), c AS (SELECT CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CAST(p_size % 6 * 10 AS INT) AS code FROM part) SELECT code, count(*) AS n FROM c JOIN f ON c.row = f.row AND c.col = f.col GROUP BY 1")
def landcover_of_flood(spark: SparkSession, sf: str) -> DataFrame:
    at = v.pixel("p_partkey", 50)
    cover = v.table(spark, sf, "part").select(at["row"].alias("row"), at["col"].alias("col"), (F.col("p_size") % 6 * 10).cast("int").alias("code"))
    flood = v.stack(spark, sf).where("time = 7 and vv < 0.3").select("row", "col")
    return raster.landcover_of_flood(cover, flood)
