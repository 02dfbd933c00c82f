"""Slice assembly: the slices of one pass become one image with one time.

A pass over an area is delivered in slices that follow each other within seconds and overlap by a
few lines. Slices are brought together by session windows over their times, per pass; their pixels
then meet by image, row and column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed attributes that make a pass.
PASS = ("orbitDirection", "relativeOrbitNumber")


def slice_plan(scenes: DataFrame, keys: tuple[str, ...] = PASS, gap: str = "60 seconds", most: int = 2) -> DataFrame:
    """keys, image_ts, n_slices, slices, supported: the images that scenes (keys, scene_id, start) make.

    A scene that starts less than ``gap`` after the one before it, in one pass, belongs to the same
    image. ``slices`` are in the order of their starts and then ids; ``image_ts`` is the mean of
    the starts. Images of more than ``most`` slices are not supported: they stay in the plan, so
    that a user sees them, and ``assemble_slices`` leaves them out. Scenes without start or id go;
    a repeated row is one scene.
    """
    known = scenes.where("start is not null and scene_id is not null").select(*keys, "scene_id", "start").distinct()
    image = known.groupBy(*keys, F.session_window("start", gap).alias("_w")).agg(
        F.timestamp_micros(F.round(F.avg(F.unix_micros("start"))).cast("long")).alias("image_ts"),
        F.count("*").alias("n_slices"),
        F.array_sort(F.collect_list(F.struct("start", "scene_id"))).alias("slices"),
    )
    return image.select(*keys, "image_ts", "n_slices", F.transform("slices", lambda s: s["scene_id"]).alias("slices"), (F.col("n_slices") <= most).alias("supported"))


def assemble_slices(pixels: DataFrame, plan: DataFrame, bands: tuple[str, ...], seam: str = "first", keys: tuple[str, ...] = PASS) -> DataFrame:
    """keys, image_ts, row, col, bands, n_slices of each supported image.

    ``pixels``: scene_id, row, col and the bands. Where two slices have a value, ``seam='first'``
    takes the earlier slice's; ``seam='feather'`` goes over from one to the other along the rows
    that both slices have, in proportion to the way into that stretch. A band that is NULL in one
    slice comes from the other, NULL in both stays NULL. Pixels of scenes outside the plan go.
    """
    if seam not in ("first", "feather"):
        raise ValueError(f"no such seam: {seam}")
    used = plan.where("supported").select(*keys, "image_ts", "n_slices", F.posexplode("slices").alias("_place", "scene_id"))
    met = pixels.select("scene_id", "row", "col", *bands).join(used, "scene_id")
    on = [*keys, "image_ts"]
    if seam == "first":
        value = [F.min_by(b, F.when(F.col(b).isNotNull(), F.col("_place"))).alias(b) for b in bands]
        return met.groupBy(*on, "row", "col").agg(*value, F.first("n_slices").alias("n_slices"))
    extent = met.groupBy(*on, "_place").agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    # one row per image: the rows that all its slices have, and the place of the slice that comes first along the rows
    shared = extent.groupBy(*on).agg(F.max("r0").alias("_a"), F.min("r1").alias("_b"), F.min(F.struct("r0", "r1", "_place"))["_place"].alias("_upper"))
    into = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("row") - F.col("_a") + 0.5) / (F.col("_b") - F.col("_a") + 1)))
    # slices that share no row need no weight, as each pixel has one
    share = F.when(F.col("_a") > F.col("_b"), F.lit(1.0)).when(F.col("_place") == F.col("_upper"), 1 - into).otherwise(into)
    weighed = met.join(shared, on).withColumn("_w", F.when(F.col("n_slices") == 1, F.lit(1.0)).otherwise(share))

    def mixed(b: str):
        known = F.when(F.col(b).isNotNull(), F.col("_w"))
        # a pixel with no weight at all (at the far end of one slice, missing in the other) keeps its plain value
        return F.coalesce(F.try_divide(F.sum(known * F.col(b)), F.nullif(F.sum(known), F.lit(0.0))), F.avg(b)).alias(b)

    return weighed.groupBy(*on, "row", "col").agg(*[mixed(b) for b in bands], F.first("n_slices").alias("n_slices"))
