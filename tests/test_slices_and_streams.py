"""Slices of a pass, and the newest product of a stream in several triggers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inundata.operators import catalogue, slices
from inundata.streaming.rain import stream_new_products


def at(seconds):
    return dt.datetime(2024, 1, 1, 23, 59, 30) + dt.timedelta(seconds=seconds)


def test_plan_by_gap_and_pass(spark):
    rows = [("A", 1, 1, at(0)), ("A", 1, 2, at(25)), ("A", 2, 3, at(5)), ("B", 1, 4, at(84)), ("A", 1, 5, at(86)), ("A", 1, 6, at(111)), ("A", 1, 7, at(136)), ("A", 1, 7, at(136)), ("A", 1, None, at(0)), ("A", 1, 9, None)]
    plan = slices.slice_plan(spark.createDataFrame(rows, "orbitDirection string, relativeOrbitNumber int, scene_id int, start timestamp"))
    got = {(r.orbitDirection, r.relativeOrbitNumber, tuple(r.slices)): (r.image_ts, r.n_slices, r.supported) for r in plan.collect()}
    # the pair of the first pass goes over midnight; three slices are one image that isn't supported
    assert got[("A", 1, (1, 2))] == (at(12.5), 2, True)
    assert got[("A", 1, (5, 6, 7))] == (at(111), 3, False)
    assert {k[2] for k in got} == {(1, 2), (3,), (4,), (5, 6, 7)} and all(v[2] for k, v in got.items() if len(k[2]) < 3)


@pytest.mark.parametrize("seam", ["first", "feather"])
def test_seams(spark, seam):
    """Rows 0 to 5 and 4 to 9, the later slice first along the rows in the second image."""
    plan = spark.createDataFrame([(1, at(0), 2, [10, 11], True), (2, at(9), 2, [21, 20], True), (3, at(20), 1, [30], True), (4, at(50), 3, [40, 41, 42], False)], "track int, image_ts timestamp, n_slices long, slices array<int>, supported boolean")
    rows = [(s, r, 0, 1.0, None if r == 5 else 2.0) for s in (10, 20, 40) for r in range(6)] + [(s, r, 0, 5.0, 4.0) for s in (11, 21, 41) for r in range(4, 10)] + [(30, 3, 0, None, 8.0), (99, 0, 0, 1.0, 1.0)]
    got = {(r.track, r.row): (r.v, r.w) for r in slices.assemble_slices(spark.createDataFrame(rows, "scene_id int, row int, col int, v double, w double"), plan, ("v", "w"), seam, ("track",)).collect()}
    assert set(got) == {(t, r) for t in (1, 2) for r in range(10)} | {(3, 3)}
    assert got[3, 3] == (None, 8.0)
    for track in (1, 2):
        assert [got[track, r][0] for r in (0, 3, 6, 9)] == [1.0, 1.0, 5.0, 5.0]
        assert got[track, 5][1] == 4.0  # missing in one slice
    if seam == "first":
        assert [got[1, 4][0], got[1, 5][0], got[2, 4][0], got[2, 5][0]] == [1.0, 1.0, 5.0, 5.0]
    else:
        assert [got[t, r][0] for t in (1, 2) for r in (4, 5)] == pytest.approx([2.0, 4.0, 2.0, 4.0])
    with pytest.raises(ValueError):
        slices.assemble_slices(plan, plan, (), "none")


def test_newest_product_over_several_triggers(spark, tmp_path):
    """Shuffled publications, one file a trigger: as the batch job has it, each begin time once."""
    base = dt.datetime(2024, 3, 1)
    rows = [(k % 3, base + dt.timedelta(minutes=(k * 7) % 50), base + dt.timedelta(minutes=(k * 31) % 211), k) for k in range(600)]
    kind = "mission int, begin timestamp, published timestamp, id long"
    for part in range(4):
        spark.createDataFrame(rows[part::4], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(-1, base + dt.timedelta(days=99), base, -1)], kind).coalesce(1).write.parquet(f"{tmp_path}/end")
    stream = lambda path: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path)
    newest = stream_new_products(stream(f"{tmp_path}/*"), keys=("mission",))
    query = newest.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where(F.col("id") >= 0).select("mission", "begin", "published", "id").collect()))
    batch = catalogue.latest_product(spark.createDataFrame(rows, kind), keys=("mission",)).select("mission", "begin", "published", "id")
    assert got == sorted(map(tuple, batch.collect())) and len(got) == 150
