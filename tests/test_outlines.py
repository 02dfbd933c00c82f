"""Polygons of whole regions, scan lines, GeoJSON."""

import glob
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inundata.operators import outlines, raster, regions
from inundata.sources import files


def pixels(spark, mask, **more):
    return spark.createDataFrame([(*more.values(), int(r), int(c)) for r, c in np.argwhere(mask)], "".join(f"{k} int, " for k in more) + "row int, col int")


def found(spark, mask, diagonal=False, tile=9):
    return regions.connected_components(pixels(spark, mask), diagonal, tile).cache()


def plain(shapes):
    return {r.region: [[[(p.x, p.y) for p in ring] for ring in shape] for shape in r.polygons] for r in shapes.collect()}


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def inside(ring, x, y):
    return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in zip(ring, ring[1:])) % 2 == 1


@pytest.mark.parametrize("diagonal", [False, True])
def test_polygons_hold_their_own_cells_only(spark, diagonal):
    """Cell centres by the even-odd rule, against the mask, and the same polygons at every tile size."""
    mask = np.random.default_rng(12).random((14, 19)) < 0.55
    own_regions = found(spark, mask, diagonal)
    own = {(r.row, r.col): r.region for r in own_regions.collect()}
    whole = plain(outlines.region_polygons(own_regions, tile=50))
    assert set(whole) == set(own.values())
    held = {}
    for region, shapes in whole.items():
        for outer, *holes in shapes:
            assert outer[0] == outer[-1] and area(outer) > 0 and all(area(h) < 0 for h in holes)
            for ring in (outer, *holes):  # no corner on a straight side
                assert all((a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(ring, ring[1:], ring[2:]))
            for r in range(14):
                for c in range(19):
                    if inside(outer, c + 0.5, r + 0.5) and not any(inside(h, c + 0.5, r + 0.5) for h in holes):
                        assert (r, c) not in held
                        held[r, c] = region
    assert held == own
    for tile in (4,) if diagonal else (2, 7):
        assert plain(outlines.region_polygons(own_regions, tile=tile)) == whole


def test_nested_rings_and_holes_across_tiles(spark):
    """Frames inside frames, each a region, with lakes that cross tile borders."""
    mask = np.zeros((40, 40), bool)
    for k in range(0, 20, 4):
        mask[k : 40 - k, k : 40 - k] = True
        mask[k + 2 : 38 - k, k + 2 : 38 - k] = False
    mask[18:22, 18:22] = True
    got = plain(outlines.region_polygons(found(spark, mask), tile=6))
    sizes = sorted((len(shapes), len(shapes[0]), sum(area(r) for r in shapes[0])) for shapes in got.values())
    assert sizes == [(1, 1, 64.0)] + [(1, 2, float((40 - 2 * k) ** 2 - (36 - 2 * k) ** 2)) for k in (12, 8, 4, 0)]


def test_a_long_winding_region(spark):
    """One spiral whose border passes every tile many times; keys keep dates apart."""
    mask = np.zeros((21, 21), bool)
    mask[::4] = True
    for k, r in enumerate(range(0, 20, 4)):
        mask[r : r + 4, 20 if k % 2 == 0 else 0] = True
    flood = pixels(spark, mask, flood_ts=1).unionByName(pixels(spark, ~mask, flood_ts=2))
    keys = ("flood_ts",)
    shapes = outlines.region_polygons(regions.connected_components(flood, tile=8, keys=keys), 5, keys).cache()
    rows = {(r.flood_ts, r.region): r for r in outlines.polygon_area(shapes, keys).collect()}
    assert rows[1, 0].area == mask.sum() and rows[1, 0].holes == 0
    assert sum(r.area for k, r in rows.items() if k[0] == 2) == (~mask).sum()
    assert outlines.region_polygons(regions.connected_components(flood.limit(0), tile=8, keys=keys), 5, keys).count() == 0


def test_geojson_is_whole(spark, tmp_path):
    mask = np.random.default_rng(5).random((20, 20)) < 0.35
    flood = pixels(spark, mask, flood_ts=7)
    keys = ("flood_ts",)
    shapes = outlines.to_map(outlines.region_polygons(regions.connected_components(flood, True, 6, keys), 6, keys), (2, 0, 100, 0, -3, 50)).cache()
    about = spark.createDataFrame([(7, "storm", None, "red"), (8, "storm", "no flood", None)], "flood_ts int, flood_event string, description string, plot_color string")
    path = str(tmp_path / "out")
    files.write_geojson(files.geojson_lines(shapes, about), path)
    texts = {k: "".join(open(p).read() for p in sorted(glob.glob(f"{path}/flood_ts={k}/part-*"))) for k in (7, 8)}
    empty, full = json.loads(texts[8]), json.loads(texts[7])
    assert empty == {"type": "FeatureCollection", "flood_event": "storm", "description": "no flood", "features": []}
    assert (full["flood_event"], full["plot_color"], full["type"]) == ("storm", "red", "FeatureCollection") and "description" not in full
    assert {f["geometry"]["type"] for f in full["features"]} == {"Polygon", "MultiPolygon"}
    r, c = np.nonzero(mask)
    assert full["bbox"] == [100 + 2 * c.min(), 50 - 3 * (r.max() + 1), 102 + 2 * c.max(), 50 - 3 * r.min()]
    total = 0
    for f in full["features"]:
        g = f["geometry"]
        for outer, *holes in [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]:
            assert area(outer) > 0 and all(area(h) < 0 for h in holes)  # counter-clockwise, north up
            total += area(outer) + sum(map(area, holes))
    assert total == 6 * mask.sum()
    assert sorted(map(repr, files.read_geojson(spark, path).select("region", "polygons").collect())) == sorted(map(repr, shapes.select("region", "polygons").collect()))


@pytest.mark.parametrize("unit,flip", [(1.0, False), (1e-4, False), (1e3, True)])
def test_rasterize_in_any_unit(spark, unit, flip):
    """Against the even-odd rule at every centre, in rows that run north or south."""
    rings = [(0, 3, [(1, 1), (9, 1), (9, 7), (1, 7)]), (1, 5, [(-40, -40), (60, -40), (4, 5)]), (2, 8, [(2, 2), (2, 2), (2, 2)]), (3, 9, [(3, 3), (8, 9), (8, 3), (3, 9), (3, 3)])]
    shapes = [(k, a, [(x * unit, y * unit) for x, y in ring]) for k, a, ring in rings]
    polygons = spark.createDataFrame([*shapes, shapes[3]], "place int, attr int, ring array<struct<lon: double, lat: double>>")
    grid = spark.range(144).selectExpr("cast(id div 12 as int) as row", "cast(id % 12 as int) as col")
    x0, dx, y0, dy = (11.5, -1, 11.5, -1) if flip else (0.5, 1, 0.5, 1)
    got = raster.rasterize_polygons(grid, polygons, x0 * unit, y0 * unit, dx * unit, dy * unit).collect()
    assert len(got) == 144
    for r in got:
        hit = [a for _, a, ring in rings if inside([*ring, ring[0]], x0 + r.col * dx, y0 + r.row * dy)]
        assert r.attr == (hit[-1] if hit else None)


def test_many_corners_on_many_pixels(spark):
    """A wavy disc of 100,000 corners over a million pixels."""
    n, size = 100_000, 1000
    turn = F.col("id") * (2 * math.pi / n)
    reach = 380 + 60 * F.sin(40 * turn)
    ring = spark.range(n).select(F.struct("id", (500 + reach * F.cos(turn)).alias("lon"), (500 + reach * F.sin(turn)).alias("lat")).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("ring"))
    area_of = ring.select(F.transform("ring", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("ring"))
    grid = spark.range(size * size).selectExpr(f"cast(id div {size} as int) as row", f"cast(id % {size} as int) as col")
    got = raster.clip_to_area(grid, area_of, 0.5, 0.5, 1.0, 1.0)
    y, x = np.mgrid[0:size, 0:size] + 0.5
    angle = np.arctan2(y - 500, x - 500)
    want = np.hypot(x - 500, y - 500) < 380 + 60 * np.sin(40 * angle)
    assert abs(got.count() - want.sum()) < 200  # chords and curve differ by a few centres
    assert got.where("row = 500 and col = 500").count() == 1 and got.where("row < 50").count() == 0
