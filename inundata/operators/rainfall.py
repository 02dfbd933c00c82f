"""Rainfall: area means, hourly and daily totals, forecast stitching, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inundata.functions.scalar import latest_run, metres_to_mm, rate_to_mm_per_hour
from inundata.operators.scans import running_sums


def period_plan(hours: DataFrame, ts: str = "ts") -> DataFrame:
    """year, month, days, hours, is_last_day: an hourly period by month, its last day apart."""
    last = hours.agg(F.to_date(F.max(ts)).alias("last"))
    is_last = F.to_date(ts) == F.col("last")
    return (
        hours.crossJoin(F.broadcast(last))  # one row
        .groupBy(F.year(ts).alias("year"), F.month(ts).alias("month"), is_last.alias("is_last_day"))
        .agg(F.array_sort(F.collect_set(F.dayofmonth(ts))).alias("days"), F.array_sort(F.collect_set(F.hour(ts))).alias("hours"))
    )


def hour_spine(frame: DataFrame, start: Column, end: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every hour from ``start`` to ``end`` (aggregates of ``frame``), per key."""
    return frame.groupBy(*keys).agg(F.date_trunc("hour", start).alias("a"), F.date_trunc("hour", end).alias("b")).select(
        *keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("ts")
    )


def rain_window_end(end: Column, now: Column) -> Column:
    """The end of the period, not later than five days before now."""
    return F.least(end, now - F.expr("INTERVAL 5 DAYS"))


def rain_area_mean(grid: DataFrame, value: str = "tp_m", keys: tuple[str, ...] = ()) -> DataFrame:
    """ts, tp_mm: mean over latitudes of each longitude, then over longitudes, in millimetres."""
    by_lon = grid.groupBy(*keys, "ts", "lon").agg(F.avg(value).alias("v"))
    return by_lon.groupBy(*keys, "ts").agg(metres_to_mm(F.avg("v")).alias("tp_mm"))


def rain_hourly(spine: DataFrame, series: list[DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """ts, tp_mm: sums over data sets on every hour; missing hours 0, negative sums 0."""
    every = series[0].select(*keys, "ts", "tp_mm")
    for more in series[1:]:
        every = every.unionByName(more.select(*keys, "ts", "tp_mm"))
    on = [*keys, "ts"]
    return spine.select(*on).join(every, on, "full").groupBy(*on).agg(F.greatest(F.lit(0.0), F.sum(F.coalesce("tp_mm", F.lit(0.0)))).alias("tp_mm"))


def rain_daily(hourly: DataFrame, days: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """day, tp_mm: daily totals on every day of ``days``; empty days 0."""
    totals = hourly.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.sum("tp_mm").alias("tp_mm"))
    return days.select(*keys, "day").distinct().join(totals, [*keys, "day"], "left").select(*keys, "day", F.coalesce("tp_mm", F.lit(0.0)).alias("tp_mm"))


def rain_daily_with_missing(hourly: DataFrame, flood_days: DataFrame) -> DataFrame:
    """day, tp_mm: daily totals, and flood days outside the data with NULL; gaps stay NULL."""
    totals = hourly.groupBy(F.to_date("ts").alias("day")).agg(F.sum("tp_mm").alias("tp_mm"))
    ends = totals.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return spine.unionByName(flood_days.select("day")).distinct().join(totals, "day", "left")


def gfs_hourly(grid: DataFrame) -> DataFrame:
    """ts, tp_mm: mean rate of each run and forecast hour, as millimetres per hour at its valid time."""
    valid = F.col("run_ts") + F.make_dt_interval(hours=F.col("fhour"))
    return grid.groupBy("run_ts", "fhour").agg(F.avg("prate").alias("r")).groupBy(valid.alias("ts")).agg(rate_to_mm_per_hour(F.avg("r")).alias("tp_mm"))


def forecast_spine(days: DataFrame, hours_ahead: int, latency: int = 4) -> DataFrame:
    """run_ts, fhour: the forecasts to ask for on ``days`` (day, now).

    Four runs a day, none later than the latest that is out ``latency`` hours after its start. Runs
    before that give their first six hours, that one ``hours_ahead``. Early in a day the latest is
    yesterday's last.
    """
    out = latest_run(F.hour("now") - latency).cast("int")
    latest = F.date_trunc("day", "now") + F.make_dt_interval(hours=out * 6)
    runs = days.select(latest.alias("latest"), F.explode(F.array(*[F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.lit(h)) for h in (0, 6, 12, 18)])).alias("run_ts"))
    horizon = F.when(F.col("run_ts") == F.col("latest"), F.lit(hours_ahead - 1)).otherwise(F.lit(5))
    return runs.where("run_ts <= latest").select("run_ts", F.explode(F.sequence(F.lit(0), horizon)).alias("fhour"))


def forecast_stitch(runs: DataFrame) -> DataFrame:
    """ts, run_ts, fhour: the forecast that supplies each valid hour.

    Older runs give their hours 0 to 5, the latest its whole horizon; the newest run wins an hour.
    """
    latest = runs.agg(F.max("run_ts").alias("latest"))
    usable = runs.crossJoin(F.broadcast(latest)).where((F.col("run_ts") == F.col("latest")) | (F.col("fhour") <= 5))  # one row
    valid = F.col("run_ts") + F.make_dt_interval(hours=F.col("fhour"))
    best = usable.groupBy(valid.alias("ts")).agg(F.max(F.struct("run_ts", "fhour")).alias("b"))
    return best.select("ts", "b.run_ts", "b.fhour")


def marker_position(days: DataFrame, markers: DataFrame) -> DataFrame:
    """marker, place: 0-based bar of each marker, the number of days before it less one.

    Running counts over ranges of the merged days and markers; no pair of them is formed.
    """
    merged = days.select(F.col("day").cast("timestamp").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("timestamp").alias("marker")).unionByName(
        markers.select(F.col("marker").alias("at"), F.lit(0).alias("n"), "marker")
    )
    # a marker stands before the day that begins with it
    placed = running_sums(merged, ["at", "n"], {"upto": F.col("n")})
    return placed.where("marker is not null").select("marker", (F.col("upto") - 1).cast("int").alias("place")).distinct()
