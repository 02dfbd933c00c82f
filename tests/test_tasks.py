"""What one task gets: plans and row counts of steps that once met in a single one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inundata.functions import kernels
from inundata.operators import delineate, halo, outlines, raster, regions, stats, tiles
from tests.test_neighbourhoods import frame, sequential_growth


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [(), ("area",)])
def test_pixels_are_not_dealt_by_key(spark, keys):
    """Quantiles and ends of a key go to its pixels; a key may be one raster with all of them."""
    df = spark.range(1000).select((F.col("id") % 2).alias("area"), F.col("id").alias("row"), F.lit(0).alias("col"), (F.col("id") * 7 % 1000).cast("double").alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = [
            stats.quantile_clip(df, "t", 0.1, 0.9, keys), stats.quantile_trim(df, "t", 0.1, 0.9, keys), stats.histogram(df, "t", 10, keys), stats.kittler_threshold(df, "t", keys),
            stats.quantiles(df, "t", 0.1, 0.9, keys), stats.histogram_compare(df.withColumn("f", F.col("t") < 500), "f", 10, keys=keys),
        ]
        for found in made[:3] + made[5:]:
            assert "SortMergeJoin" not in plan(found) and "ShuffledHashJoin" not in plan(found)
        trimmed = {tuple(r) for r in made[1].groupBy(*keys).agg(F.min("t"), F.max("t"), F.count("*")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # values are 0 to 999 once each, even ones in area 0
    assert trimmed == ({(0, 100.0, 898.0, 400), (1, 101.0, 899.0, 400)} if keys else {(100.0, 899.0, 800)})


def test_blank_places_are_put_in_by_chip(spark):
    """Whole chips of a raster with gaps: each place once, the largest of several pixels, nothing exploded before they meet."""
    rows = [(r, c, None if (r + c) % 5 == 0 else float(r * 10 + c)) for r in range(7) for c in range(9) if (r, c) not in {(0, 0), (3, 4), (6, 8)}]
    pixels = spark.createDataFrame([*rows, (1, 1, 99.0)], "row int, col int, t double")
    chips = raster.whole_chips(pixels, "t", 4)
    held = {(r, c): v for r, c, v in rows} | {(1, 1): 99.0}
    want = {(cy, cx): [held.get((cy * 4 + k // 4, cx * 4 + k % 4)) for k in range(16)] for cy in range(2) for cx in range(3)}
    assert {(x.cy, x["cx"]): list(x["values"]) for x in chips.collect()} == want
    assert "Generate" not in plan(chips)


def test_growth_writes_as_many_files_as_partitions(spark):
    """A high raster: a version has a file per band at most, however many rows of chips there are."""
    t = np.zeros((400, 3))
    t[5:395, 1] = -np.arange(1, 391) / 100
    t[5, 1] = 0.5
    mask = np.zeros(t.shape, bool)
    mask[[4, 5, 200, 201], 1] = True
    written = []
    got = delineate.region_growing(frame(spark, t), frame(spark, mask, "mask"), max_rounds=8, tile=2, batch=4, written=written)
    assert len(got.inputFiles()) <= 4 * (1 + len(written)) and len(written) == 2
    want = sequential_growth(t, mask, 8)
    assert {(r.row, r.col) for r in got.collect() if r.flooded} == set(zip(*map(list, np.nonzero(want)), strict=True)) and want.sum() > mask.sum()


def test_tiles_are_labelled_many_at_once(spark):
    """Whole tiles meet in a call however batches cut them; keys may be NULL; tasks stay as many as partitions."""
    rng = np.random.default_rng(6)
    grids = {k: rng.random((11, 13)) < 0.5 for k in ("a", None, "b")}
    rows = [(k, int(r), int(c)) for k, g in grids.items() for r, c in np.argwhere(g)]
    pixels = spark.createDataFrame(rows, "area string, row int, col int").withColumns({"ty": F.floor(F.col("row") / 4), "tx": F.floor(F.col("col") / 4)})

    def work(pdf):
        first = pdf.groupby("_tile")["row"].transform("size")
        return (first + 100 * pdf["_tile"].nunique()).to_numpy()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = tiles.by_tiles(pixels, ("area",), work, "n long", 4)
        got = found.collect()
        assert "REPARTITION_BY_NUM" in plan(found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.area or "", r.row, r.col) for r in got) == sorted((k or "", r, c) for k, r, c in rows)
    assert all(r.n % 100 == grids[r.area][r.row // 4 * 4 : r.row // 4 * 4 + 4, r.col // 4 * 4 : r.col // 4 * 4 + 4].sum() for r in got)
    assert max(r.n // 100 for r in got) > 1


def test_chips_are_packed_and_run_many_at_once(spark):
    """A call gets a stack of chips, each with what lies around it; neither packing nor running has a call per chip."""
    grid = np.arange(1.0, 13 * 11 + 1).reshape(13, 11)
    wide = np.full((13 + 40, 11 + 40), np.nan)
    wide[20:33, 20:31] = grid
    chips = halo.to_chips(frame(spark, grid), 4, ("t",), cells=40)
    assert chips.frame.count() == 12 and len(chips.frame.inputFiles()) <= 4

    def work(own, grids):
        for cy, cx, g in zip(own["cy"].to_pylist(), own["cx"].to_pylist(), grids["t"], strict=True):
            assert np.array_equal(g, wide[4 * cy + 18 : 4 * cy + 26, 4 * cx + 18 : 4 * cx + 26], equal_nan=True)
        return {"t": grids["t"][:, 2:6, 2:6] + 1000.0 * len(own), halo.HERE: grids[halo.HERE][:, 2:6, 2:6]}

    for cells in (1, 1_000_000):
        found = halo.stacked(chips, 2, work, chips.frame, halo.strips(chips, 2), cells)
        assert "InPandas" not in plan(found).replace("MapInPandas", "")
        got = {(r.cy, r.cx): np.frombuffer(r.t).reshape(4, 4) for r in found.collect()}
        assert len(got) == 12
        for (cy, cx), g in got.items():
            assert np.array_equal(g % 1000, wide[4 * cy + 20 : 4 * cy + 24, 4 * cx + 20 : 4 * cx + 24], equal_nan=True)
        together = {int(np.nanmin(g) // 1000) for g in got.values()}
        assert together == {1} if cells == 1 else max(together) > 1


def test_morphology_joins_labels_and_not_places(spark):
    """Pixels meet the labels that are kept, once a labelling, and are never joined to each other by row and column."""
    mask = np.random.default_rng(7).random((17, 14)) < 0.6
    keyed = frame(spark, mask, "flag").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.floor(F.col("row") / 5).cast("int").alias("stripe"), "flag")
    some = keyed.where("not (row = 3 and col = 4)").unionByName(keyed.where("row = 3 and col = 4").withColumn("flag", F.lit(None).cast("boolean")))
    for found in (regions.morphology(some, 400, 100, 4, ("stripe",)), regions.fill_small_holes(some, 3, 4, ("stripe",)), regions.remove_small_objects(some, 3, 4, ("stripe",))):
        assert not [line for line in plan(found).splitlines() if "Join" in line and "row#" in line]
        assert [t for _, t in found.dtypes] == (["int", "int", "int", "boolean"])
        assert found.count() == 17 * 14 and found.where("flag is null").count() <= 1
    by_tile = [sorted(map(tuple, regions.morphology(keyed, 400, 100, tile, ("stripe",)).collect())) for tile in (3, 64)]
    assert by_tile[0] == by_tile[1] and {x[-1] for x in by_tile[0]} == {True, False}


def test_tiles_are_traced_many_at_once(spark):
    """Tiles one below the other give what each gives alone; tracing has no call per tile."""
    rng = np.random.default_rng(8)
    grids = [rng.integers(0, 3, (5, 6)) for _ in range(7)]
    tall = np.concatenate([np.pad(g, ((0, 1), (0, 0))) for g in grids])
    moved = lambda k, found: [(p + 36 * k, kind, [(x, y + 6 * k) for x, y in ring], a, b) for p, kind, ring, a, b in found]
    assert sorted(kernels.traced(tall, 5)) == sorted(x for k, g in enumerate(grids) for x in moved(k, kernels.traced(g)))
    mask = rng.random((20, 23)) < 0.5
    found = regions.connected_components(frame(spark, mask, "flag").where("flag").select("row", "col", F.lit("a").alias("area")), tile=8, keys=("area",)).cache()
    rows = {cells: sorted(map(repr, outlines._pieces(found, 4, ("area",), cells).collect())) for cells in (1, 100_000)}
    assert rows[1] == rows[100_000] and len(rows[1]) > 100
    assert "FlatMapGroupsInPandas" not in plan(outlines._pieces(found, 4, ("area",)))
