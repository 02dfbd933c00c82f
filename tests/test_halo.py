"""Chips and their edges: what is shuffled, which chips a batch writes, and keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inundata.functions import kernels
from inundata.operators import delineate, halo, raster, stats
from tests.test_neighbourhoods import frame, sequential_growth


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("tile, reach", [(8, 3), (5, 7), (40, 1)])
def test_halo_is_what_lies_around(spark, tile, reach):
    rng = np.random.default_rng(3)
    grid, flag = rng.random((23, 31)), rng.random((23, 31)) < 0.4
    pixels = frame(spark, grid).join(frame(spark, flag, "flag"), ["row", "col"]).where("row <> 4 or col < 3")
    chips = halo.to_chips(pixels, tile, ("t",), ("flag",))
    wide = np.full((23 + 4 * (tile + reach), 31 + 4 * (tile + reach)), np.nan)
    at = 2 * (tile + reach)
    wide[at : at + 23, at : at + 31] = grid
    wide[at + 4, at + 3 : at + 31] = np.nan
    dark = np.zeros(wide.shape, bool)
    dark[at : at + 23, at : at + 31] = flag
    dark[at + 4, at + 3 : at + 31] = False

    def look(own, r0, c0, grids):
        side = tile + 2 * reach
        square = (slice(r0 + at, r0 + at + side), slice(c0 + at, c0 + at + side))
        same = np.array_equal(grids["t"], wide[square], equal_nan=True) and np.array_equal(grids["flag"] > 0, dark[square])
        same = same and np.array_equal(grids[halo.HERE] > 0, ~np.isnan(wide[square]))
        import pandas as pd

        return pd.DataFrame([(own["cy"], own["cx"], bool(same))])

    got = halo.with_halo(chips, reach, look, "cy int, cx int, same boolean").collect()
    assert len(got) == -(-23 // tile) * -(-31 // tile) and all(r.same for r in got)


def test_only_strips_are_shuffled(spark):
    """Bodies are read from buckets; a strip has as many cells as the halo needs."""
    chips = halo.to_chips(frame(spark, np.random.default_rng(1).random((64, 64))), 16, ("t",))
    found = halo.with_halo(chips, 2, lambda own, r0, c0, grids: None, "n int")
    assert len(exchanges(found)) == 1 and "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()
    sizes = {(r.oy, r.ox): len(r.t) // 8 for r in halo.strips(chips, 2).collect()}
    assert sizes == {(oy, ox): (2 if oy else 16) * (2 if ox else 16) for oy in (-1, 0, 1) for ox in (-1, 0, 1) if oy or ox}


def test_growth_writes_active_chips_only(spark):
    """A flood in one corner of a large raster: settled chips are neither run nor written again."""
    t = np.zeros((96, 96))
    t[2:40, 3] = -np.arange(1, 39)  # a trench that gets darker, along which the flood runs
    t[70, 70] = -5
    mask = np.zeros(t.shape, bool)
    mask[2, 2:4] = mask[70, 70] = True
    written = []
    got = delineate.region_growing(frame(spark, t), frame(spark, mask, "mask"), tile=8, batch=2, written=written).collect()
    want = sequential_growth(t, mask)
    assert want.sum() > 20 and {(r.row, r.col) for r in got if r.flooded} == set(zip(*map(list, np.nonzero(want)), strict=True)) and len(got) == 96 * 96
    assert len(written) > 5 and max(written) <= 12 and written[-1] <= 6  # of 144 chips


def test_keys_are_rasters_of_their_own(spark):
    rng = np.random.default_rng(4)
    grids = {k: kernels.gaussian_smooth(rng.standard_normal((20, 17)), 1.0) * 6 for k in ("a", "b")}
    keyed = lambda name, make: frame(spark, make(grids["a"]), name).withColumn("event", F.lit("a")).unionByName(frame(spark, make(grids["b"]), name).withColumn("event", F.lit("b")))
    scores, mask = keyed("t", lambda g: g), keyed("mask", lambda g: g < -2.5)
    grown = delineate.region_growing(scores, mask, tile=8, batch=2, keys=("event",), strict_edges=True)
    slopes = raster.slope(scores, 10.0, 10.0, "t", tile=6, keys=("event",))
    p = delineate.FloodParams(halves=(4, 6), unit_m2=900, local_bimodality=0.5, tile=8, least_pixels=20)
    water = spark.createDataFrame([("a", -3.0, 1.0), ("b", -2.0, 0.5)], "event string, mean double, std double")
    local = delineate.adaptive_threshold(scores, mask, None, None, p, ("event",), water)
    for k, mean, std in (("a", -3.0, 1.0), ("b", -2.0, 0.5)):
        one, flags = frame(spark, grids[k]), frame(spark, grids[k] < -2.5, "mask")
        rows = lambda df, *c: sorted(tuple(r) for r in df.select("row", "col", *c).collect())
        own = f"event = '{k}'"
        blocks = delineate.FloodParams(sizes=(10, 20), least_pixels=20, smoothing=False, vote=0.4, bimodality=0.45)
        assert rows(delineate.bimodality_mask(scores, blocks, ("event",)).where(own), "mask") == rows(delineate.bimodality_mask(one, blocks), "mask")
        assert rows(grown.where(own), "flooded") == rows(delineate.region_growing(one, flags, strict_edges=True, tile=64), "flooded")
        assert rows(slopes.where(own), "slope") == rows(raster.slope(one, 10.0, 10.0, "t"), "slope")
        assert rows(local.where(own), "probability", "flooded") == rows(delineate.adaptive_threshold(one, flags, mean, std, p), "probability", "flooded")


def test_minimum_error_over_a_wide_span():
    """Values that span ten thousand whole numbers: running moments, no square of bins."""
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(-4000, 300, 5000), rng.normal(5000, 500, 9000)])
    assert -3500 < kernels.kittler(values) < 4000


def test_windows_smoothed_together():
    rng = np.random.default_rng(6)
    windows = rng.random((5, 31, 12))
    windows[2, 20, 3] = np.nan
    got = kernels.smooth_windows(windows)
    want = np.stack([kernels.gaussian_smooth(w) for w in windows])
    assert np.allclose(got, want, equal_nan=True) and np.isnan(got[2]).any()
    assert np.allclose(kernels.bimodalities(windows, 50), [kernels.bimodality(w, 50) for w in windows])


def test_pixel_tables_meet_without_a_shuffle(spark):
    """Scores from a stack and its static fields, joined with another layer: no exchange by pixel."""
    rng = np.random.default_rng(5)
    stack = spark.createDataFrame([(k, r, c, float(rng.random())) for k in range(3) for r in range(12) for c in range(9)], "time int, row long, col long, vv_vh_db double")
    static = frame(spark, rng.random((12, 9)), "lia")
    truth = raster.pixel_table(frame(spark, rng.random((12, 9)) < 0.5, "truth"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        weighted = stats.weighted_stack(raster.pixel_table(stack), raster.pixel_table(static))
        scored = stats.t_scores(weighted, clip=None).join(truth, ["row", "col"])
        assert [x for x in exchanges(scored) if "row#" in x] == [] and scored.count() == 108
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = stats.t_scores(stats.weighted_stack(stack, static), clip=None)
    assert sorted(map(tuple, scored.select("row", "col", "t").collect())) == sorted(map(tuple, plain.select("row", "col", "t").collect()))
