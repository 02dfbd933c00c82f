"""Matching scenes to orbit files: interval joins on mission and day, never a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inundata.functions.scalar import ORBIT_NAME, ORBIT_SECONDS, orbit_fields
from inundata.operators.scans import running_sums


def list_orbit_files(names: DataFrame, name: str = "name") -> DataFrame:
    """Names of orbit files that parse, with their fields; others are dropped silently."""
    parsed = names.where(F.col(name).rlike(ORBIT_NAME))
    return parsed.select(F.col(name), *[c.alias(k) for k, c in orbit_fields(F.col(name), checked=True).items()]).where("orbit_type is not null")


def _seconds(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(float(n)))


def _days(start: Column, stop: Column) -> Column:
    """The days that an interval touches."""
    return F.sequence(F.to_date(start), F.to_date(stop), F.expr("INTERVAL 1 DAY"))


def _candidates(scenes: DataFrame, orbits: DataFrame, need_start: Column, need_stop: Column, strict: bool) -> DataFrame:
    """Scenes with each orbit file that covers them, matched by mission and day bucket."""
    s = scenes.withColumns({"_from": need_start, "_to": need_stop}).withColumn("_day", F.to_date("_from"))
    o = orbits.select(*[F.col(c).alias(f"o_{c}") for c in orbits.columns]).withColumn("_oday", F.explode(_days(F.col("o_start"), F.col("o_stop"))))
    within = (
        (F.col("o_start") < F.col("_from")) & (F.col("o_stop") > F.col("_to"))
        if strict
        else (F.col("o_start") <= F.col("_from")) & (F.col("o_stop") >= F.col("_to"))
    )
    return s.join(o, (F.col("mission") == F.col("o_mission")) & (F.col("_day") == F.col("_oday")) & within)


def orbit_for_scene(scenes: DataFrame, orbits: DataFrame, margin0: float = ORBIT_SECONDS + 60, margin1: float = 300.0) -> DataFrame:
    """scene_id, filename: the newest orbit file that covers the scene with margins; none, no row.

    ``scenes``: scene_id, mission, start, stop. ``orbits``: filename, mission, orbit_type, created,
    start, stop.
    """
    found = _candidates(scenes, orbits, F.col("start") - _seconds(margin0), F.col("stop") + _seconds(margin1), strict=False)
    return found.groupBy("scene_id").agg(F.max(F.struct("o_created", "o_filename")).alias("b")).select("scene_id", F.col("b.o_filename").alias("filename"))


def orbit_with_fallback(scenes: DataFrame, orbits: DataFrame, margin1: float = 300.0) -> DataFrame:
    """scene_id, filename, orbit_type: precise first, then restituted with a short margin; unmatched NULL."""
    precise = orbit_for_scene(scenes, orbits.where("orbit_type = 'precise'"), ORBIT_SECONDS + 60, margin1)
    rest = scenes.join(precise, "scene_id", "left_anti")
    restituted = orbit_for_scene(rest, orbits.where("orbit_type = 'restituted'"), 60.0, margin1)
    both = precise.withColumn("orbit_type", F.lit("precise")).unionByName(restituted.withColumn("orbit_type", F.lit("restituted")))
    return scenes.select("scene_id").join(both, "scene_id", "left")


def orbit_catalogue_lookup(scenes: DataFrame, orbits: DataFrame, before: float = ORBIT_SECONDS + 60, after: float = 60.0) -> DataFrame:
    """scene_id, filename: strictly covering, the earliest start first; precise else restituted."""
    found = _candidates(scenes, orbits.where("orbit_type in ('precise', 'restituted')"), F.col("start") - _seconds(before), F.col("start") + _seconds(after), strict=True)
    rank = F.struct(F.when(F.col("o_orbit_type") == "precise", 0).otherwise(1).alias("k"), "o_start", "o_filename")
    return found.groupBy("scene_id").agg(F.min(rank).alias("b")).select("scene_id", F.col("b.o_filename").alias("filename"))


def scenes_missing_orbit(scenes: DataFrame, orbits: DataFrame) -> DataFrame:
    """Scenes, one per unique id and then per start, whose start lies in no existing orbit file.

    The mission is not compared. Survivors of duplicates are those with the least scene id.
    """
    by_id = scenes.groupBy("unique_id").agg(F.min_by(F.struct("*"), "scene_id").alias("s")).select("s.*")
    one = by_id.groupBy("start").agg(F.min_by(F.struct("*"), "scene_id").alias("s")).select("s.*")
    o = orbits.select(F.col("start").alias("o_start"), F.col("stop").alias("o_stop")).withColumn("o_day", F.explode(_days(F.col("o_start"), F.col("o_stop"))))
    return one.join(o, (F.to_date("start") == F.col("o_day")) & (F.col("o_start") < F.col("start")) & (F.col("start") < F.col("o_stop")), "left_anti")


def osv_range(osv: DataFrame, low: Column, high: Column, extra: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """State vectors in [low, high] with ``extra`` more on either side, clamped at the ends.

    Empty when none is in range.
    """
    numbered = running_sums(osv, ["utc"], {"_i": F.lit(1)}, keys)
    inside = F.when((F.col("utc") >= low) & (F.col("utc") <= high), F.col("_i"))
    span = numbered.groupBy(*keys).agg(F.min(inside).alias("_a"), F.max(inside).alias("_b"))
    joined = numbered.join(span, list(keys)) if keys else numbered.crossJoin(F.broadcast(span))  # one row
    return joined.where(F.col("_i").between(F.col("_a") - extra, F.col("_b") + extra)).drop("_i", "_a", "_b")


def orbit_requests(dates: DataFrame, missions: tuple[str, ...] = ("S1A", "S1B"), ts: str = "ts", mission: str = "mission") -> DataFrame:
    """ts, mission: each date with its mission, or with every mission when it has none.

    A date without hour and minute is meant to cover the day: its hour becomes 23.
    """
    bare = (F.hour(ts) == 0) & (F.minute(ts) == 0)
    moved = F.when(bare, F.col(ts) + F.expr("INTERVAL 23 HOURS")).otherwise(F.col(ts))
    wanted = F.when(F.col(mission).isNull(), F.array(*[F.lit(m) for m in missions])).otherwise(F.array(mission))
    return dates.select(moved.alias(ts), F.explode(wanted).alias(mission))
