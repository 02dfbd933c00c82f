"""Rasters, catalogues, orbits and rainfall as views over the driver's tables, in Spark and in SQL.

Whole tables always; a pixel is (key div width, key mod width).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.functions.scalar import to_db, zero_to_null


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zoneless times as UTC timestamps."""
    raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return raw.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in raw.dtypes])


def pixel(key: str, width: int) -> dict[str, Column]:
    return {"row": F.floor(F.col(key) / width).cast("int"), "col": (F.col(key) % width).cast("int")}


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, row, col, vv, vh and their decibels: mean prices and quantities of part and line number."""
    raw = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_linenumber").alias("time")).agg(
        (F.avg("l_extendedprice") / 1e5).alias("vv"), (F.avg("l_quantity") / 1e2).alias("vh")
    )
    vv, vh = zero_to_null(F.col("vv")), zero_to_null(F.col("vh"))
    at = pixel("l_partkey", 50)
    return raw.select("time", at["row"].alias("row"), at["col"].alias("col"), "vv", "vh", to_db(vv).alias("vv_db"), to_db(vh).alias("vh_db"), to_db(vv * vh).alias("vv_vh_db"))


STACK = """stack AS (
  SELECT CAST(l_partkey // 50 AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col, l_linenumber AS time,
         avg(l_extendedprice) / 1e5 AS vv, avg(l_quantity) / 1e2 AS vh
  FROM lineitem GROUP BY 1, 2, 3)"""


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = pixel("p_partkey", 50)
    return table(spark, sf_dir, "part").select(
        at["row"].alias("row"), at["col"].alias("col"), (20.0 + F.col("p_size") % 25).alias("lia"), F.col("p_retailprice").alias("dem")
    )


STATIC = """static AS (
  SELECT CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, 20e0 + p_size % 25 AS lia, p_retailprice AS dem FROM part)"""

WEIGHTED = f"""{STACK}, {STATIC}, weighted AS (
  SELECT time, s.row, s.col, 10e0 * log10(vv * vh) * cos(radians(lia)) AS v
  FROM stack s LEFT JOIN static t ON s.row = t.row AND s.col = t.col)"""

RAW_SCORES = f"""{WEIGHTED}, ends AS (SELECT max(time) AS last, count(DISTINCT time) - 1 AS n FROM weighted), stats AS (
  SELECT row, col, avg(v) FILTER (WHERE time < last) AS mean, stddev_pop(v) FILTER (WHERE time < last) AS std,
         max(v) FILTER (WHERE time = last) AS flood, any_value(n) AS n
  FROM weighted, ends GROUP BY row, col), raw AS (
  SELECT row, col, CASE WHEN std > 0 THEN (flood - mean) / (std / sqrt(n))
    WHEN std = 0 AND flood > mean THEN CAST('inf' AS DOUBLE) WHEN std = 0 AND flood < mean THEN CAST('-inf' AS DOUBLE) END AS t FROM stats)"""

SCORES = f"""{RAW_SCORES}, q AS (SELECT quantile_cont(t, 0.0001) AS lo, quantile_cont(t, 0.9999) AS hi FROM raw), scores AS (
  SELECT row, col, CASE WHEN t IS NOT NULL THEN greatest(lo, least(hi, t)) END AS t FROM raw, q)"""


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, t: order prices as scores around zero, 125 pixels a row."""
    at = pixel("o_orderkey", 125)
    return table(spark, sf_dir, "orders").select(at["row"].alias("row"), at["col"].alias("col"), ((F.col("o_totalprice") - 150000.0) / 50000.0).alias("t"))


BAND = """band AS (SELECT CAST(o_orderkey // 125 AS INT) AS row, CAST(o_orderkey % 125 AS INT) AS col, (o_totalprice - 150000e0) / 50000e0 AS t FROM orders)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def rain_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (hour), lat, lon, tp_m: event values by user cell; negative values stay."""
    return events(spark, sf_dir).select(F.date_trunc("hour", "ts").alias("ts"), (F.col("user_id") % 10).alias("lat"), F.floor(F.col("user_id") / 10).alias("lon"), F.col("value").alias("tp_m"))


RAIN = """grid AS (SELECT date_trunc('hour', ts) AS ts, user_id % 10 AS lat, user_id // 10 AS lon, value AS tp_m FROM events)"""
AREA = f"""{RAIN}, area AS (SELECT ts, avg(v) * 1000e0 AS tp_mm FROM (SELECT ts, lon, avg(tp_m) AS v FROM grid GROUP BY 1, 2) GROUP BY 1)"""
HOURLY = f"""{AREA}, spine AS (SELECT unnest(generate_series((SELECT min(ts) FROM grid), (SELECT max(ts) FROM grid), INTERVAL 1 HOUR)) AS ts), hourly AS (
  SELECT s.ts, greatest(0e0, sum(coalesce(tp_mm, 0e0))) AS tp_mm FROM spine s LEFT JOIN area a ON s.ts = a.ts GROUP BY 1)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue product per event: Id, PublicationDate, Attributes, GeoFootprint."""
    e = events(spark, sf_dir)
    entry = lambda name, value: F.struct(F.lit(name).alias("Name"), value.cast("string").alias("Value"))
    begin = F.date_trunc("minute", "ts")
    lon, lat = (F.col("user_id") % 36).cast("double"), (F.col("user_id") % 17).cast("double")
    corner = lambda a, b: F.array(lon + a, lat + b)
    return e.select(
        F.col("event_id").alias("Id"),
        F.col("ts").alias("PublicationDate"),
        F.array(
            entry("productType", F.when(F.col("event_type") == "error", "SLC").otherwise("GRD")),
            entry("orbitDirection", F.when(F.col("user_id") % 2 == 0, "ASCENDING").otherwise("DESCENDING")),
            entry("relativeOrbitNumber", F.col("user_id") % 3),
            entry("beginningDateTime", F.date_format(begin, "yyyy-MM-dd HH:mm:ss")),
            entry("k", F.get_json_object("props", "$.k")),
        ).alias("Attributes"),
        F.struct(F.array(F.array(corner(0, 0), corner(2, 0), corner(2, 2), corner(0, 2), corner(0, 0))).alias("coordinates")).alias("GeoFootprint"),
    )


PRODUCTS = """products AS (
  SELECT event_id AS id, ts AS published, CASE WHEN event_type = 'error' THEN 'SLC' ELSE 'GRD' END AS ptype,
         CASE WHEN user_id % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS direction, user_id % 3 AS rel,
         date_trunc('minute', ts) AS begin, json_extract_string(props, '$.k') AS k, user_id % 36 AS lon, user_id % 17 AS lat
  FROM events)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, unique_id, mission, start, stop: one scene per order."""
    start = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scene_id"),
        (F.col("o_orderkey") % 5000).alias("unique_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "S1A").otherwise("S1B").alias("mission"),
        start.alias("start"),
        (start + F.expr("INTERVAL 25 SECONDS")).alias("stop"),
    )


SCENES = """scenes AS (SELECT o_orderkey AS scene_id, o_orderkey % 5000 AS unique_id, CASE WHEN o_orderkey % 2 = 0 THEN 'S1A' ELSE 'S1B' END AS mission,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS start, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + INTERVAL 25 SECONDS AS stop FROM orders)"""


def orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename, mission, orbit_type, created, start, stop: files of 26 hours around ship dates."""
    d = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), (F.col("l_suppkey") % 3).alias("k"), (F.col("l_suppkey") % 2).alias("m")).distinct()
    start = F.col("d").cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    mission = F.when(F.col("m") == 0, "S1A").otherwise("S1B")
    kind = F.when(F.col("k") == 0, "restituted").otherwise("precise")
    return d.select(
        F.concat_ws("_", mission, kind, F.date_format("d", "yyyyMMdd"), F.col("k").cast("string")).alias("filename"),
        mission.alias("mission"), kind.alias("orbit_type"),
        (F.col("d").cast("timestamp") + F.make_dt_interval(days=F.lit(20), hours=F.col("k").cast("int"))).alias("created"),
        start.alias("start"), (start + F.expr("INTERVAL 26 HOURS")).alias("stop"),
    )


ORBITS = """days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, l_suppkey % 3 AS k, l_suppkey % 2 AS m FROM lineitem), orbits AS (
  SELECT concat_ws('_', CASE WHEN m = 0 THEN 'S1A' ELSE 'S1B' END, CASE WHEN k = 0 THEN 'restituted' ELSE 'precise' END, strftime(d, '%Y%m%d'), CAST(k AS VARCHAR)) AS filename,
    CASE WHEN m = 0 THEN 'S1A' ELSE 'S1B' END AS mission, CASE WHEN k = 0 THEN 'restituted' ELSE 'precise' END AS orbit_type,
    CAST(d AS TIMESTAMP) + INTERVAL 20 DAYS + to_hours(CAST(k AS INT)) AS created,
    CAST(d AS TIMESTAMP) - INTERVAL 1 HOUR AS start, CAST(d AS TIMESTAMP) + INTERVAL 25 HOURS AS stop FROM days)"""
