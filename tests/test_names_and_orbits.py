"""Golden values of names and orbit choices, and their edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inundata.functions import scalar
from inundata.operators import catalogue, orbits


def parsed(spark, name, fields):
    return spark.createDataFrame([(name,)], "name string").select(*[c.alias(k) for k, c in fields(F.col("name")).items()]).first()


def test_product_names(spark):
    r = parsed(spark, "S1A_IW_SLC__1SDV_20230823T154908_20230823T154935_050004_060418_521B.zip", scalar.product_fields)
    assert (r.mission, r.polarisation, r.relative_orbit) == ("S1A", "DV", 57)
    assert (r.start, r.stop) == (dt.datetime(2023, 8, 23, 15, 49, 8), dt.datetime(2023, 8, 23, 15, 49, 35))
    r = parsed(spark, "S1A_IW_SLC__1SDV_20180408T043025_20180408T043053_021371_024C9B_1B70", scalar.product_fields)
    assert (r.absolute_orbit, r.relative_orbit, r.unique_id) == (21371, 124, "1B70")
    r = parsed(spark, "S1B_WV_OCN__2SSV_20180522T161319_20180522T164846_011036_014389_67D8", scalar.product_fields)
    assert r.relative_orbit == 160
    assert parsed(spark, "nothing", scalar.product_fields).mission is None


def test_orbit_names(spark):
    r = parsed(spark, "S1A_OPER_AUX_RESORB_OPOD_20230823T174849_V20230823T141024_20230823T172754", scalar.orbit_fields)
    assert r.orbit_type == "restituted"
    assert (r.start, r.stop) == (dt.datetime(2023, 8, 23, 14, 10, 24), dt.datetime(2023, 8, 23, 17, 27, 54))


SCENES = "scene_id string, mission string, start timestamp, stop timestamp"
ORBITS = "filename string, mission string, orbit_type string, created timestamp, start timestamp, stop timestamp"


def t(*a):
    return dt.datetime(*a)


def test_orbit_of_two_scenes(spark):
    scenes = spark.createDataFrame([("a", "S1A", t(2018, 4, 20, 4, 30, 26), t(2018, 4, 20, 4, 30, 54)), ("b", "S1B", t(2018, 5, 2, 4, 30, 26), t(2018, 5, 2, 4, 30, 54)), ("c", "S1A", t(2018, 6, 1), t(2018, 6, 1, 0, 1))], SCENES)
    files = spark.createDataFrame(
        [
            ("old", "S1A", "precise", t(2018, 5, 1), t(2018, 4, 19, 22, 59, 42), t(2018, 4, 21, 0, 59, 42)),
            ("new", "S1A", "precise", t(2018, 5, 10), t(2018, 4, 19, 22, 59, 42), t(2018, 4, 21, 0, 59, 42)),
            ("other", "S1B", "precise", t(2018, 5, 22), t(2018, 5, 1, 22, 59, 42), t(2018, 5, 3, 0, 59, 42)),
            ("short", "S1A", "restituted", t(2018, 6, 1), t(2018, 5, 31, 23, 58), t(2018, 6, 1, 3)),
        ],
        ORBITS,
    )
    assert {tuple(r) for r in orbits.orbit_for_scene(scenes, files).collect()} == {("a", "new"), ("b", "other")}
    got = {r.scene_id: (r.filename, r.orbit_type) for r in orbits.orbit_with_fallback(scenes, files).collect()}
    assert got == {"a": ("new", "precise"), "b": ("other", "precise"), "c": ("short", "restituted")}


def test_thinning_compares_with_the_last_kept(spark):
    base = t(2024, 1, 1)
    times = [(base + dt.timedelta(seconds=s),) for s in (0, 59, 61, 119, 122)]
    kept = catalogue.thin_datetimes(spark.createDataFrame(times, "ts timestamp")).orderBy("ts").collect()
    assert [(r.ts - base).seconds for r in kept] == [0, 61, 122]


def test_state_vectors_are_clamped(spark):
    rows = [(t(2024, 1, 1, 0, m),) for m in range(10)]
    osv = spark.createDataFrame(rows, "utc timestamp")
    pick = lambda a, b, k: [r.utc.minute for r in orbits.osv_range(osv, F.lit(t(2024, 1, 1, 0, a)), F.lit(t(2024, 1, 1, 0, b)), k).orderBy("utc").collect()]
    assert pick(3, 5, 1) == [2, 3, 4, 5, 6]
    assert pick(0, 1, 2) == [0, 1, 2, 3]
    assert pick(20, 30, 1) == []


def test_request_without_time_covers_the_day(spark):
    dates = spark.createDataFrame([(t(2024, 1, 1), None), (t(2024, 1, 1, 5), "S1A")], "ts timestamp, mission string")
    assert sorted((r.ts.hour, r.mission) for r in orbits.orbit_requests(dates).collect()) == [(5, "S1A"), (23, "S1A"), (23, "S1B")]


def test_aoi_needs_one_geometry(spark, tmp_path):
    from inundata.sources.files import aoi_from_bbox, aoi_from_vector

    ring = aoi_from_bbox(spark, 1, 2, 3, 4).first().ring
    assert len(ring) == 5 and ring[0] == ring[4]
    one = '{"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 2], [3, 4], [1, 2]]]}}]}'
    (tmp_path / "one.json").write_text(one)
    assert tuple(aoi_from_vector(spark, str(tmp_path / "one.json")).first().bounds) == (1.0, 2.0, 3.0, 4.0)
    (tmp_path / "none.json").write_text('{"features": []}')
    with pytest.raises(ValueError, match="one geometry"):
        aoi_from_vector(spark, str(tmp_path / "none.json"))


def test_tile_sets_of_any_size(spark):
    import itertools
    import random

    rng = random.Random(4)
    cases = [{c: [c] for c in range(6)}, {0: [0], 1: [0, 1]}, {}]
    cases += [{i: rng.sample(range(8), rng.randint(1, 3)) for i in range(9)} for _ in range(3)]
    for tiles, cells in zip(cases, (6, 3, 2, 8, 8, 8), strict=True):
        sets = (c for k in range(1, len(tiles) + 1) for c in itertools.combinations(sorted(tiles), k))
        want = next((list(c) for c in sets if len(set().union(*[tiles[i] for i in c])) >= cells), None)
        cover = spark.createDataFrame(list(tiles.items()), "tile int, cells array<int>")
        assert [r.tiles for r in catalogue.tile_cover_set(cover, cells).collect()] == ([want] if want else [])
