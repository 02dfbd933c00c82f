"""Registered queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.functions import scalar
from inundata.operators import catalogue, delineate, orbits, outlines, patches, rainfall, raster, regions, slices, stats, validate
from inundata.plans import views as v
from inundata.plans.registry import register

S = SparkSession
D = DataFrame


def r(c, digits: int = 6):
    return F.round(c, digits)


# -- scores and thresholds ---------------------------------------------------------------------


@register(f"WITH {v.STACK} SELECT time, row, col, round(10e0 * log10(nullif(vv, 0)), 6) AS vv_db, round(10e0 * log10(nullif(vh, 0)), 6) AS vh_db, round(10e0 * log10(vv * vh), 6) AS vv_vh_db FROM stack")
def to_db(spark: S, sf: str) -> D:
    return v.stack(spark, sf).select("time", "row", "col", r("vv_db").alias("vv_db"), r("vh_db").alias("vh_db"), r("vv_vh_db").alias("vv_vh_db"))


@register(f"WITH {v.STACK} SELECT time, row, col, round(vv, 12) AS vv, round((greatest(0e0, least(0.15e0, vv)) - 0.0953e0) / 0.0427e0, 6) AS x_vv, round((greatest(0e0, least(0.15e0, vh)) - 0.0264e0) / 0.0215e0, 6) AS x_vh FROM stack")
def model_normalise(spark: S, sf: str) -> D:
    s = v.stack(spark, sf).withColumns({"a": scalar.from_db(F.col("vv_db")), "b": scalar.from_db(F.col("vh_db"))})
    return s.select("time", "row", "col", r("a", 12).alias("vv"), r(scalar.model_normalise(F.col("a"), 0)).alias("x_vv"), r(scalar.model_normalise(F.col("b"), 1)).alias("x_vh"))


@register(f"WITH {v.WEIGHTED} SELECT time, row, col, round(v, 6) AS v FROM weighted")
def lia_weight(spark: S, sf: str) -> D:
    return stats.weighted_stack(v.stack(spark, sf), v.static(spark, sf)).select("time", "row", "col", r("v").alias("v"))


def _weighted(spark: S, sf: str) -> D:
    return stats.weighted_stack(v.stack(spark, sf), v.static(spark, sf))


@register(f"WITH {v.WEIGHTED} SELECT row, col, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n FROM weighted WHERE time < (SELECT max(time) FROM weighted) GROUP BY 1, 2")
def pre_flood_stats(spark: S, sf: str) -> D:
    return stats.pre_flood_stats(_weighted(spark, sf)).select("row", "col", r("mean").alias("mean"), r("std").alias("std"), "n")


def _scores(spark: S, sf: str) -> D:
    return stats.t_scores(_weighted(spark, sf))


@register(f"WITH {v.SCORES} SELECT row, col, round(t, 5) AS t FROM scores")
def t_scores(spark: S, sf: str) -> D:
    return _scores(spark, sf).select("row", "col", r("t", 5).alias("t"))


OTSU = """h AS (SELECT least(255, CAST(floor((t - lo) * 256 / (hi - lo)) AS INT)) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n
    FROM src, (SELECT min(t) AS lo, max(t) AS hi FROM src) WHERE t IS NOT NULL GROUP BY 1),
  f AS (SELECT b.bin, coalesce(h.n, 0) AS n, lo + (b.bin + 0.5e0) * (hi - lo) / 256 AS x FROM (SELECT unnest(range(256)) AS bin) b LEFT JOIN (SELECT bin, n FROM h) h ON b.bin = h.bin, (SELECT min(lo) AS lo, max(hi) AS hi FROM h)),
  c AS (SELECT bin, x, sum(n) OVER a AS w1, sum(n) OVER b AS w2, sum(n * x) OVER a AS s1, sum(n * x) OVER b AS s2 FROM f
    WINDOW a AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  otsu AS (SELECT x AS threshold FROM c WHERE w1 > 0 AND w2 > 0 ORDER BY round(w1 * w2 * pow(s1 / w1 - s2 / w2, 2), 9) DESC, bin LIMIT 1)"""

TRIMMED = f"""{v.SCORES}, q2 AS (SELECT quantile_cont(t, 0.01) AS lo, quantile_cont(t, 0.99) AS hi FROM scores), src AS (
  SELECT row, col, t FROM scores, q2 WHERE t >= lo AND t <= hi)"""


@register(f"WITH {TRIMMED}, {OTSU} SELECT round(threshold, 5) AS threshold FROM otsu")
def otsu_threshold(spark: S, sf: str) -> D:
    return stats.otsu_threshold(stats.quantile_trim(_scores(spark, sf), "t", 0.01, 0.99, kept=True), "t", kept=True).select(r("threshold", 5).alias("threshold"))


@register(f"WITH {TRIMMED}, {OTSU} SELECT s.row // 4 AS tile_row, s.col // 10 AS tile_col, count(*) AS n_pixels, count(*) FILTER (WHERE t < threshold) AS n_flooded FROM scores s, otsu GROUP BY 1, 2")
def flooded_pixels(spark: S, sf: str) -> D:
    """The flagship: stack, weights, scores, global threshold, flooded pixels per tile."""
    scores = _scores(spark, sf)
    threshold = stats.otsu_threshold(stats.quantile_trim(scores, "t", 0.01, 0.99, kept=True), "t", kept=True)
    flooded = scores.crossJoin(F.broadcast(threshold))  # one row
    return flooded.groupBy(F.floor(F.col("row") / 4).cast("int").alias("tile_row"), F.floor(F.col("col") / 10).cast("int").alias("tile_col")).agg(
        F.count("*").alias("n_pixels"), F.count_if(scalar.below(F.col("t"), F.col("threshold"))).alias("n_flooded")
    )


@register(f"WITH {v.SCORES}, q2 AS (SELECT quantile_cont(t, 0.01) AS lo, quantile_cont(t, 0.99) AS hi FROM scores) SELECT row, col, round(CASE WHEN t IS NOT NULL THEN greatest(lo, least(hi, t)) END, 5) AS t FROM scores, q2")
def quantile_clip(spark: S, sf: str) -> D:
    return stats.display_stretch(_scores(spark, sf), "t", kept=True).select("row", "col", r("t", 5).alias("t"))


@register(f"WITH {TRIMMED} SELECT row, col, round(t, 5) AS t FROM src")
def quantile_trim(spark: S, sf: str) -> D:
    return stats.quantile_trim(_scores(spark, sf), "t", 0.01, 0.99, kept=True).select("row", "col", r("t", 5).alias("t"))


KITTLER = """e AS (SELECT CAST(trunc(quantile_cont(t, 0.001)) AS BIGINT) AS lo, CAST(trunc(quantile_cont(t, 0.999)) AS BIGINT) AS hi FROM src),
  h AS (SELECT least((hi - lo + 1) * 10 - 1, CAST(floor((t - lo) * ((hi - lo + 1) * 10) / (hi - lo)) AS BIGINT)) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM src, e WHERE t BETWEEN lo AND hi GROUP BY 1),
  g AS (SELECT bin, CAST(n AS DOUBLE) AS n, lo + bin * (hi - lo) / ((hi - lo + 1) * 10e0) AS g FROM h),
  s AS (SELECT bin, g, sum(n) OVER a AS c, sum(n * g) OVER a AS m, sum(n * g * g) OVER a AS s, sum(n) OVER () AS cc, sum(n * g) OVER () AS mm, sum(n * g * g) OVER () AS ss FROM g WINDOW a AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT bin, g, c / cc AS p, s / c - pow(m / c, 2) AS vf, CASE WHEN cc > c THEN (ss - s) / (cc - c) - pow((mm - m) / (cc - c), 2) END AS vb FROM s),
  k AS (SELECT g FROM d WHERE vf > 1e-12 AND vb > 1e-12 AND p < 1 ORDER BY round(p * ln(sqrt(vf)) + (1 - p) * ln(sqrt(vb)) - p * ln(p) - (1 - p) * ln(1 - p), 9), bin LIMIT 1)"""


@register(f"WITH {v.SCORES}, src AS (SELECT t FROM scores WHERE t IS NOT NULL), {KITTLER} SELECT round(g, 5) AS threshold FROM k")
def kittler_threshold(spark: S, sf: str) -> D:
    return stats.kittler_threshold(_scores(spark, sf), "t", kept=True).select(r("threshold", 5).alias("threshold"))


@register("""WITH m AS (SELECT p_type AS kind, count(*) AS n, avg(p_retailprice) AS mu FROM part GROUP BY 1), z AS (
  SELECT kind, any_value(n) AS n, avg(pow(p_retailprice - mu, 2)) AS m2, avg(pow(p_retailprice - mu, 3)) AS m3, avg(pow(p_retailprice - mu, 4)) AS m4 FROM part JOIN m ON p_type = kind GROUP BY 1)
  SELECT kind, n, CASE WHEN n >= 20 THEN round((pow(m3 / pow(m2, 1.5e0), 2) + 1) / (m4 / (m2 * m2) - 3 + 3e0 * (n - 1) * (n - 1) / ((n - 2e0) * (n - 3e0))), 6) END AS bc FROM z""")
def bimodality_coefficient(spark: S, sf: str) -> D:
    p = v.table(spark, sf, "part").select(F.col("p_type").alias("kind"), F.col("p_retailprice").alias("x"))
    return stats.bimodality_coefficient(p, "x", ("kind",), least=20).select("kind", "n", r("bc").alias("bc"))


@register(f"""WITH {v.SCORES}, raw0 AS (SELECT CASE WHEN t IS NULL THEN NULL WHEN t < -1 THEN t ELSE 0e0 END AS t FROM scores), q2 AS (SELECT quantile_cont(t, 0.01) AS lo, quantile_cont(t, 0.99) AS hi FROM raw0)
  SELECT round(avg(greatest(lo, least(hi, t))), 5) AS mean, round(stddev_pop(greatest(lo, least(hi, t))), 5) AS std FROM raw0, q2 WHERE t IS NOT NULL""")
def water_stats(spark: S, sf: str) -> D:
    flagged = _scores(spark, sf).withColumn("mask", scalar.below(F.col("t"), -1.0))
    return stats.water_stats(flagged).select(r("mean", 5).alias("mean"), r("std", 5).alias("std"))


@register(f"""WITH {v.BAND}, both_ AS (SELECT 'all' AS source, t FROM band UNION ALL SELECT 'flagged', t FROM band WHERE t < 0),
  q AS (SELECT source, quantile_cont(t, 0.005) AS a, quantile_cont(t, 0.995) AS b FROM both_ GROUP BY 1), tr AS (SELECT x.source, t FROM both_ x JOIN q ON x.source = q.source WHERE t >= a AND t <= b),
  e AS (SELECT source, min(t) AS lo, max(t) AS hi FROM tr GROUP BY 1)
  SELECT tr.source, least(99, CAST(floor((t - lo) * 100 / (hi - lo)) AS INT)) AS bin, count(*) AS n FROM tr JOIN e ON tr.source = e.source GROUP BY 1, 2""")
def histogram_compare(spark: S, sf: str) -> D:
    return stats.histogram_compare(v.band(spark, sf).withColumn("f", F.col("t") < 0), "f", kept=True)


# -- catalogue ---------------------------------------------------------------------------------


def _catalogue(spark: S, sf: str) -> D:
    full = catalogue.catalogue_attributes(v.products(spark, sf), ("productType", "orbitDirection", "relativeOrbitNumber", "beginningDateTime", "k", "none"))
    return full.withColumn("begin", F.try_to_timestamp("beginningDateTime"))


@register(f"WITH {v.PRODUCTS} SELECT id, ptype AS product_type, direction, CAST(rel AS VARCHAR) AS rel, k, CAST(NULL AS VARCHAR) AS none FROM products")
def catalogue_attributes(spark: S, sf: str) -> D:
    return _catalogue(spark, sf).select(F.col("Id").alias("id"), F.col("productType").alias("product_type"), F.col("orbitDirection").alias("direction"), F.col("relativeOrbitNumber").alias("rel"), "k", "none")


@register(f"WITH {v.PRODUCTS} SELECT id, begin FROM products WHERE ptype = 'GRD' AND begin > TIMESTAMP '2024-01-05 00:00:00' AND begin < TIMESTAMP '2024-01-20 00:00:00' AND lon <= 20 AND lon + 2 >= 10 AND lat <= 12 AND lat + 2 >= 5 ORDER BY begin, id LIMIT 1000")
def catalogue_query(spark: S, sf: str) -> D:
    p = catalogue.catalogue_attributes(v.products(spark, sf), ("productType", "beginningDateTime"))
    box = scalar.ring_bounds(scalar.bbox_ring(10, 5, 20, 12))
    got = catalogue.catalogue_query(p, box, F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return got.select(F.col("Id").alias("id"), "begin")


#: A triangle and its sides as half planes: a footprint's box must reach over each of them.
TRIANGLE = ((10.0, 5.0), (20.0, 5.0), (10.0, 12.0))


@register(f"""WITH {v.PRODUCTS} SELECT id, begin FROM products WHERE ptype = 'GRD' AND k IS NOT NULL AND begin > TIMESTAMP '2024-01-05 00:00:00' AND begin < TIMESTAMP '2024-01-20 00:00:00'
  AND lon <= 20 AND lon + 2 >= 10 AND lat <= 12 AND lat + 2 >= 5 AND 7 * (lon - 10) + 10 * (lat - 5) <= 70 ORDER BY begin, id LIMIT 1000""")
def catalogue_query_area(spark: S, sf: str) -> D:
    """Footprints that meet a triangle, of one collection."""
    p = catalogue.catalogue_attributes(v.products(spark, sf), ("productType", "beginningDateTime", "k")).withColumn("collection", F.when(F.col("k").isNotNull(), "radar"))
    area = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in TRIANGLE])
    between = [F.lit(t).cast("timestamp") for t in ("2024-01-05 00:00:00", "2024-01-20 00:00:00")]
    return catalogue.catalogue_query(p, scalar.ring_bounds(area), *between, area=area, collection="radar").select(F.col("Id").alias("id"), "begin")


@register(f"WITH {v.PRODUCTS} SELECT ptype, begin, id, published FROM products QUALIFY row_number() OVER (PARTITION BY ptype, begin ORDER BY published DESC, id) = 1")
def latest_product(spark: S, sf: str) -> D:
    p = _catalogue(spark, sf).select(F.col("productType").alias("ptype"), "begin", F.col("Id").alias("id"), F.col("PublicationDate").alias("published"))
    return catalogue.latest_product(p, keys=("ptype",)).select("ptype", "begin", "id", "published")


@register("""WITH RECURSIVE n AS (SELECT user_id % 50 AS k, ts, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts) AS i FROM (SELECT DISTINCT user_id, ts FROM events)),
  w AS (SELECT k, ts, i, ts AS last, true AS keep FROM n WHERE i = 1 UNION ALL
    SELECT n.k, n.ts, n.i, CASE WHEN n.ts - w.last >= INTERVAL 6 HOURS THEN n.ts ELSE w.last END, n.ts - w.last >= INTERVAL 6 HOURS FROM w JOIN n ON n.k = w.k AND n.i = w.i + 1)
  SELECT k, ts FROM w WHERE keep""")
def thin_datetimes(spark: S, sf: str) -> D:
    times = v.events(spark, sf).select((F.col("user_id") % 50).alias("k"), "ts")
    return catalogue.thin_datetimes(times, keys=("k",), seconds=6 * 3600.0)


@register(f"WITH {v.PRODUCTS} SELECT id FROM products WHERE (direction, rel) IN (SELECT direction, rel FROM products WHERE ptype = 'GRD' ORDER BY begin DESC, id DESC LIMIT 1)")
def same_pass_products(spark: S, sf: str) -> D:
    p = _catalogue(spark, sf)
    chosen = p.where("productType = 'GRD'").orderBy(F.col("begin").desc(), F.col("Id").desc()).limit(1)
    return catalogue.same_pass_products(p, chosen).select(F.col("Id").alias("id"))


@register("""WITH f AS (SELECT TIMESTAMP '2024-01-10 06:00:00' AS f UNION ALL SELECT TIMESTAMP '2024-01-20 12:30:00'), d AS (
  SELECT coalesce(f, date_trunc('day', ts)) AS day, ts FROM events LEFT JOIN f ON ts BETWEEN f AND f + INTERVAL 24 HOURS)
  SELECT CAST(day AS TIMESTAMP) AS day, count(*) AS n_tiles, count(*) <= 2 AS supported, round(avg(CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE)) / 1e6, 2) AS mean_s FROM d GROUP BY 1""")
def scene_day_tiles(spark: S, sf: str) -> D:
    flood = spark.createDataFrame([("2024-01-10 06:00:00",), ("2024-01-20 12:30:00",)], "s string").select(F.col("s").cast("timestamp").alias("flood_ts"))
    got = catalogue.scene_day_tiles(v.events(spark, sf), flood)
    return got.select("day", "n_tiles", "supported", r((F.unix_micros("image_ts") - 1704067200000000) / 1e6, 2).alias("mean_s"))


@register("SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def pre_flood_dates(spark: S, sf: str) -> D:
    return catalogue.pre_flood_dates(v.events(spark, sf), F.lit("2024-01-15").cast("timestamp"))


NAMES = """names AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate, (CASE WHEN l_suppkey % 2 = 0 THEN 'S1A' ELSE 'S1B' END) || '_IW_GRDH_1SDV_' || strftime(l_shipdate, '%Y%m%d') || 'T154908_' || strftime(l_shipdate, '%Y%m%d') || 'T154935_' || lpad(CAST(l_orderkey % 999999 AS VARCHAR), 6, '0') || '_060418_521B' AS name FROM lineitem)"""


def _names(spark: S, sf: str) -> D:
    stamp = F.date_format("l_shipdate", "yyyyMMdd")
    name = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "S1A").otherwise("S1B"), F.lit("_IW_GRDH_1SDV_"), stamp, F.lit("T154908_"), stamp, F.lit("T154935_"), F.lpad((F.col("l_orderkey") % 999999).cast("string"), 6, "0"), F.lit("_060418_521B"))
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", name.alias("name"))


@register(f"""WITH {NAMES} SELECT substr(name, 1, 3) AS mission, 'DV' AS polarisation, l_shipdate + INTERVAL '15:49:08' HOUR TO SECOND AS start, CAST(l_orderkey % 999999 AS INT) AS absolute_orbit, count(*) AS n FROM names GROUP BY 1, 2, 3, 4""".replace("l_shipdate + INTERVAL '15:49:08' HOUR TO SECOND", "l_shipdate + INTERVAL 56948 SECONDS"))
def parse_product_name(spark: S, sf: str) -> D:
    return catalogue.list_products(_names(spark, sf)).groupBy("mission", "polarisation", "start", "absolute_orbit").agg(F.count("*").alias("n"))


@register(f"""WITH {NAMES} SELECT substr(name, 1, 3) AS mission, CAST(l_orderkey % 999999 AS INT) AS absolute_orbit, CAST(((l_orderkey % 999999 - CASE WHEN l_suppkey % 2 = 0 THEN 73 ELSE 27 END) % 175 + 175) % 175 + 1 AS INT) AS relative_orbit, count(*) AS n FROM names GROUP BY 1, 2, 3""")
def relative_orbit(spark: S, sf: str) -> D:
    return catalogue.list_products(_names(spark, sf)).groupBy("mission", "absolute_orbit", "relative_orbit").agg(F.count("*").alias("n"))


@register("""SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'S1A' ELSE 'S1B' END AS mission, CASE l_linenumber % 4 WHEN 0 THEN 'precise' WHEN 1 THEN 'restituted' WHEN 2 THEN 'predicted' END AS orbit_type,
  CASE WHEN l_linenumber % 4 < 3 THEN l_shipdate - INTERVAL 1 HOUR END AS start, count(*) AS n FROM lineitem WHERE l_linenumber % 4 < 3 GROUP BY 1, 2, 3""")
def parse_orbit_name(spark: S, sf: str) -> D:
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    kind = F.element_at(F.array(F.lit("POE"), F.lit("RES"), F.lit("PRE"), F.lit("XXX")), F.col("l_linenumber") % 4 + 1)
    hour = F.expr("INTERVAL 1 HOUR")
    d = F.col("l_shipdate")
    name = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "S1A").otherwise("S1B"), F.lit("_OPER_AUX_"), kind, F.lit("ORB_OPOD_"), stamp(d), F.lit("_V"), stamp(d - hour), F.lit("_"), stamp(d + hour))
    parsed = orbits.list_orbit_files(v.table(spark, sf, "lineitem").select(name.alias("name")))
    return parsed.groupBy("mission", "orbit_type", "start").agg(F.count("*").alias("n"))


@register(f"WITH {NAMES} SELECT substr(name, 1, 3) AS sensor, substr(name, 18, 4) AS year, substr(name, 22, 2) AS month, substr(name, 18, 15) AS time, count(*) AS n FROM names GROUP BY 1, 2, 3, 4")
def orbit_path_parts(spark: S, sf: str) -> D:
    parts = scalar.orbit_path_parts(F.col("name"))
    return _names(spark, sf).select(*[c.alias(k) for k, c in parts.items()]).groupBy("sensor", "year", "month", "time").agg(F.count("*").alias("n"))


@register("SELECT event_id, ts AS utc, round((epoch_us(ts) % 86400000000) / 1e6, 6) AS seconds FROM events")
def parse_utc(spark: S, sf: str) -> D:
    text = F.concat(F.lit("UTC="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    e = v.events(spark, sf).select("event_id", scalar.utc_stamp(text).alias("utc"))
    return e.select("event_id", "utc", r(scalar.seconds_of_day(F.col("utc"))).alias("seconds"))


@register("""SELECT event_id, CASE WHEN hour(ts) <= 3 THEN 0 WHEN hour(ts) <= 9 THEN 1 WHEN hour(ts) <= 15 THEN 2 ELSE 3 END AS nearest, CASE WHEN hour(ts) <= 0 THEN -1 WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 12 THEN 1 WHEN hour(ts) <= 18 THEN 2 ELSE 3 END AS latest FROM events""")
def forecast_runs(spark: S, sf: str) -> D:
    h = F.hour("ts")
    return v.events(spark, sf).select("event_id", scalar.nearest_run(h).cast("int").alias("nearest"), scalar.latest_run(h).alias("latest"))


@register("SELECT user_id % 20 AS tile, arg_min(CAST(event_id AS VARCHAR), (value, CAST(event_id AS VARCHAR))) AS name, min(value) AS cloud FROM events GROUP BY 1".replace("arg_min(CAST(event_id AS VARCHAR), (value, CAST(event_id AS VARCHAR)))", "min(CASE WHEN value = m THEN CAST(event_id AS VARCHAR) END)").replace("FROM events", "FROM (SELECT *, min(value) OVER (PARTITION BY user_id % 20) AS m FROM events)"))
def clearest_per_tile(spark: S, sf: str) -> D:
    e = v.events(spark, sf).select((F.col("user_id") % 20).alias("tile"), F.col("value").alias("cloud"), F.col("event_id").cast("string").alias("name"))
    return catalogue.clearest_per_tile(e)


@register("""WITH RECURSIVE c AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS tile, list(DISTINCT s_suppkey % 4) AS cells FROM supplier GROUP BY 1),
  s AS (SELECT tile AS tiles, tile AS last, cells, 1 AS n FROM c UNION ALL
    SELECT tiles || '+' || tile, tile, list_distinct(list_concat(s.cells, c.cells)), n + 1 FROM s JOIN c ON tile > last WHERE len(s.cells) < 4 AND len(list_distinct(list_concat(s.cells, c.cells))) > len(s.cells))
  SELECT tiles FROM s WHERE len(cells) = 4 ORDER BY n, tiles LIMIT 1""")
def tile_cover_set(spark: S, sf: str) -> D:
    cover = v.table(spark, sf, "supplier").groupBy(F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("tile")).agg(F.collect_set((F.col("s_suppkey") % 4).cast("int")).alias("cells"))
    return catalogue.tile_cover_set(cover, 4).select(F.array_join("tiles", "+").alias("tiles"))


COLOURS = ("red", "orange", "yellow", "green", "blue", "indigo", "violet")


@register("SELECT day AS flood_ts, CASE WHEN i <= 7 THEN list_extract(['red', 'orange', 'yellow', 'green', 'blue', 'indigo', 'violet'], CAST(i AS INT)) END AS colour FROM (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM events))".replace("SELECT day AS flood_ts", "SELECT CAST(day AS TIMESTAMP) AS flood_ts"))
def date_colour(spark: S, sf: str) -> D:
    return catalogue.date_colour(v.events(spark, sf).select(F.date_trunc("day", "ts").alias("flood_ts")).distinct(), COLOURS)


# -- orbits ------------------------------------------------------------------------------------

T0 = "INTERVAL 5984571 MILLISECONDS"  # a revolution and a minute; fractions beyond that match nothing
OFS = f"""WITH {v.SCENES}, {v.ORBITS}, p AS (SELECT scene_id, filename, row_number() OVER (PARTITION BY scene_id ORDER BY created DESC, filename DESC) AS i FROM scenes s JOIN orbits o ON s.mission = o.mission
  AND o.start <= s.start - {T0} AND o.stop >= s.stop + INTERVAL 300 SECONDS WHERE orbit_type = 'precise')"""


@register(OFS.replace(" WHERE orbit_type = 'precise'", "") + " SELECT scene_id, filename FROM p WHERE i = 1")
def orbit_for_scene(spark: S, sf: str) -> D:
    return orbits.orbit_for_scene(v.scenes(spark, sf), v.orbits(spark, sf))


@register(OFS + """, f AS (SELECT scene_id, filename, row_number() OVER (PARTITION BY scene_id ORDER BY created DESC, filename DESC) AS i FROM scenes s JOIN orbits o ON s.mission = o.mission AND o.start <= s.start - INTERVAL 60 SECONDS AND o.stop >= s.stop + INTERVAL 300 SECONDS
  WHERE orbit_type = 'restituted' AND scene_id NOT IN (SELECT scene_id FROM p)) SELECT s.scene_id, coalesce(p.filename, f.filename) AS filename, CASE WHEN p.filename IS NOT NULL THEN 'precise' WHEN f.filename IS NOT NULL THEN 'restituted' END AS orbit_type
  FROM scenes s LEFT JOIN (SELECT * FROM p WHERE i = 1) p ON s.scene_id = p.scene_id LEFT JOIN (SELECT * FROM f WHERE i = 1) f ON s.scene_id = f.scene_id""")
def orbit_with_fallback(spark: S, sf: str) -> D:
    return orbits.orbit_with_fallback(v.scenes(spark, sf), v.orbits(spark, sf))


@register(f"""WITH {v.SCENES}, {v.ORBITS} SELECT scene_id, filename FROM (SELECT scene_id, filename, row_number() OVER (PARTITION BY scene_id ORDER BY CASE WHEN orbit_type = 'precise' THEN 0 ELSE 1 END, o.start, filename) AS i FROM scenes s JOIN orbits o ON s.mission = o.mission
  AND o.start < s.start - {T0} AND o.stop > s.start + INTERVAL 60 SECONDS) WHERE i = 1""")
def orbit_catalogue_lookup(spark: S, sf: str) -> D:
    return orbits.orbit_catalogue_lookup(v.scenes(spark, sf), v.orbits(spark, sf))


@register(f"""WITH {v.SCENES}, {v.ORBITS}, moved AS (SELECT scene_id, unique_id, mission, start + CASE WHEN scene_id % 3 = 0 THEN INTERVAL 7300 DAYS ELSE INTERVAL 0 DAYS END AS start FROM scenes),
  a AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY scene_id) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY start ORDER BY scene_id) = 1)
  SELECT scene_id, mission FROM b WHERE NOT EXISTS (SELECT 1 FROM orbits o WHERE o.start < b.start AND b.start < o.stop)""")
def scenes_missing_orbit(spark: S, sf: str) -> D:
    """A third of the scenes is moved beyond the last orbit file."""
    later = F.when(F.col("scene_id") % 3 == 0, F.expr("INTERVAL 7300 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    moved = v.scenes(spark, sf).withColumns({"start": F.col("start") + later, "stop": F.col("stop") + later})
    return orbits.scenes_missing_orbit(moved, v.orbits(spark, sf)).select("scene_id", "mission")


@register("""WITH n AS (SELECT user_id % 50 AS k, event_id, ts, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts) AS i FROM events),
  s AS (SELECT k, min(i) AS a, max(i) AS b FROM n WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1) SELECT n.k, event_id FROM n JOIN s ON n.k = s.k WHERE i BETWEEN a - 1 AND b + 1""")
def osv_range(spark: S, sf: str) -> D:
    osv = v.events(spark, sf).select((F.col("user_id") % 50).alias("k"), "event_id", F.col("ts").alias("utc"))
    return orbits.osv_range(osv, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"), keys=("k",)).select("k", "event_id")


@register("""SELECT o_orderkey, CASE WHEN hour(t) = 0 AND minute(t) = 0 THEN t + INTERVAL 23 HOURS ELSE t END AS ts, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['S1A', 'S1B'] WHEN o_orderkey % 3 = 1 THEN ['S1A'] ELSE ['S1B'] END) AS mission
  FROM (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 2 AS INT)) AS t FROM orders)""".replace("SELECT o_orderkey, CASE WHEN", "SELECT CASE WHEN"))
def orbit_requests(spark: S, sf: str) -> D:
    k = F.col("o_orderkey")
    mission = F.when(k % 3 == 1, "S1A").when(k % 3 == 2, "S1B")
    d = v.table(spark, sf, "orders").select((F.col("o_orderdate") + F.make_dt_interval(hours=(k % 2).cast("int"))).alias("ts"), mission.alias("mission"))
    return orbits.orbit_requests(d)


# -- rainfall ----------------------------------------------------------------------------------


@register(f"WITH {v.AREA} SELECT ts, round(tp_mm, 4) AS tp_mm FROM area")
def rain_area_mean(spark: S, sf: str) -> D:
    return rainfall.rain_area_mean(v.rain_grid(spark, sf)).select("ts", r("tp_mm", 4).alias("tp_mm"))


def _hourly(spark: S, sf: str) -> D:
    grid = v.rain_grid(spark, sf)
    return rainfall.rain_hourly(rainfall.hour_spine(grid, F.min("ts"), F.max("ts")), [rainfall.rain_area_mean(grid)])


@register(f"WITH {v.HOURLY} SELECT ts, round(tp_mm, 4) AS tp_mm FROM hourly")
def rain_hourly(spark: S, sf: str) -> D:
    return _hourly(spark, sf).select("ts", r("tp_mm", 4).alias("tp_mm"))


@register(f"WITH {v.HOURLY} SELECT CAST(ts AS DATE) AS day, round(sum(tp_mm), 3) AS tp_mm FROM hourly GROUP BY 1 UNION ALL SELECT DATE '2024-02-10', 0e0")
def rain_daily(spark: S, sf: str) -> D:
    hourly = _hourly(spark, sf)
    days = hourly.select(F.to_date("ts").alias("day")).unionByName(hourly.agg(F.max("ts")).select(F.lit("2024-02-10").cast("date").alias("day")))
    return rainfall.rain_daily(hourly, days).select("day", r("tp_mm", 3).alias("tp_mm"))


@register(f"WITH {v.HOURLY} SELECT CAST(ts AS DATE) AS day, round(sum(tp_mm), 3) AS tp_mm FROM hourly GROUP BY 1 UNION ALL SELECT DATE '2024-02-10', NULL")
def rain_daily_with_missing(spark: S, sf: str) -> D:
    hourly = _hourly(spark, sf)
    flood = hourly.agg(F.max("ts")).select(F.lit("2024-02-10").cast("date").alias("day"))
    return rainfall.rain_daily_with_missing(hourly, flood).select("day", r("tp_mm", 3).alias("tp_mm"))


@register("""WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events), l AS (SELECT CAST(max(ts) AS DATE) AS last FROM h)
  SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(ts AS DATE) = last AS is_last_day, string_agg(DISTINCT lpad(CAST(day(ts) AS VARCHAR), 2, '0'), ',' ORDER BY lpad(CAST(day(ts) AS VARCHAR), 2, '0')) AS days, count(DISTINCT hour(ts)) AS n_hours FROM h, l GROUP BY 1, 2, 3""")
def period_plan(spark: S, sf: str) -> D:
    plan = rainfall.period_plan(v.rain_grid(spark, sf).select("ts").distinct())
    return plan.select("year", "month", "is_last_day", F.array_join(F.transform("days", lambda d: F.lpad(d.cast("string"), 2, "0")), ",").alias("days"), F.size("hours").cast("long").alias("n_hours"))


def _gfs(spark: S, sf: str) -> D:
    run = F.date_trunc("day", "ts") + F.make_dt_interval(hours=(F.floor(F.hour("ts") / 6) * 6).cast("int"))
    return v.events(spark, sf).select(run.alias("run_ts"), (F.col("event_id") % 12).cast("int").alias("fhour"), F.col("value").alias("prate"))


GFS = "gfs AS (SELECT date_trunc('day', ts) + to_hours(CAST(hour(ts) // 6 * 6 AS INT)) AS run_ts, CAST(event_id % 12 AS INT) AS fhour, value AS prate FROM events)"


@register(f"WITH {GFS} SELECT run_ts + to_hours(fhour) AS ts, round(avg(m) * 3600, 3) AS tp_mm FROM (SELECT run_ts, fhour, avg(prate) AS m FROM gfs GROUP BY 1, 2) GROUP BY 1")
def gfs_hourly(spark: S, sf: str) -> D:
    return rainfall.gfs_hourly(_gfs(spark, sf)).select("ts", r("tp_mm", 3).alias("tp_mm"))


@register(f"""WITH {GFS}, u AS (SELECT DISTINCT run_ts, fhour FROM gfs WHERE fhour <= 5 OR run_ts = (SELECT max(run_ts) FROM gfs))
  SELECT run_ts + to_hours(fhour) AS ts, run_ts, fhour FROM u QUALIFY row_number() OVER (PARTITION BY run_ts + to_hours(fhour) ORDER BY run_ts DESC, fhour DESC) = 1""")
def forecast_stitch(spark: S, sf: str) -> D:
    return rainfall.forecast_stitch(_gfs(spark, sf).select("run_ts", "fhour").distinct())


@register("""WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT date_trunc('day', now) + to_hours(CAST(CASE WHEN hour(now) <= 4 THEN -6 WHEN hour(now) <= 10 THEN 0 WHEN hour(now) <= 16 THEN 6 WHEN hour(now) <= 22 THEN 12 ELSE 18 END AS INT)) AS latest FROM n),
  r AS (SELECT day + to_hours(CAST(h AS INT)) AS run_ts FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM events), (SELECT unnest([0, 6, 12, 18]) AS h))
  SELECT run_ts, CAST(h AS INT) AS fhour FROM r, l, (SELECT unnest(range(48)) AS h) WHERE run_ts <= latest AND h <= CASE WHEN run_ts = latest THEN 47 ELSE 5 END""")
def forecast_spine(spark: S, sf: str) -> D:
    e = v.events(spark, sf)
    days = e.select(F.to_date("ts").alias("day")).distinct().crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return rainfall.forecast_spine(days, 48)


@register("""WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events), m AS (SELECT DISTINCT date_trunc('hour', ts) AS marker FROM events WHERE event_type = 'error')
  SELECT marker, CAST((SELECT count(*) FROM d WHERE day < marker) - 1 AS INT) AS place FROM m""")
def marker_position(spark: S, sf: str) -> D:
    e = v.events(spark, sf)
    days = e.select(F.to_date("ts").alias("day")).distinct()
    return rainfall.marker_position(days, e.where("event_type = 'error'").select(F.date_trunc("hour", "ts").alias("marker")).distinct())


@register("SELECT event_type, least(max(ts), TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAYS) AS until FROM events GROUP BY 1")
def rain_window(spark: S, sf: str) -> D:
    ends = v.events(spark, sf).groupBy("event_type").agg(F.max("ts").alias("e"))
    return ends.select("event_type", rainfall.rain_window_end(F.col("e"), F.lit("2024-01-20").cast("timestamp")).alias("until"))


# -- accuracy and land cover -------------------------------------------------------------------

PAIRS = "SELECT quality AS truth, toxic AS pred FROM labels"


def _pairs(spark: S, sf: str) -> D:
    one = v.table(spark, sf, "labels").select(F.col("doc_id").alias("row"), F.lit(0).alias("col"), "quality", "toxic")
    return validate.compared(one.select("row", "col", F.col("quality").alias("value")), one.select("row", "col", F.col("toxic").alias("value")))


CF = f"""p AS ({PAIRS}), c AS (SELECT count(*) FILTER (WHERE truth = 0 AND pred = 0) AS c00, count(*) FILTER (WHERE truth = 0 AND pred = 1) AS c01, count(*) FILTER (WHERE truth = 1 AND pred = 0) AS c10, count(*) FILTER (WHERE truth = 1 AND pred = 1) AS c11 FROM p)"""


@register(f"WITH {CF} SELECT c00, c01, c10, c11 FROM c")
def confusion_matrix(spark: S, sf: str) -> D:
    return validate.confusion_matrix(_pairs(spark, sf))


@register(f"""WITH {CF}, n AS (SELECT *, CAST(c00 + c01 + c10 + c11 AS DOUBLE) AS n FROM c), m AS (SELECT (c00 + c11) / n AS po, c11 / nullif(CAST(c01 + c11 AS DOUBLE), 0) AS pr, c11 / nullif(CAST(c10 + c11 AS DOUBLE), 0) AS re,
  ((c00 + c01) / n * ((c00 + c10) / n) + (c10 + c11) / n * ((c01 + c11) / n)) AS pe FROM n) SELECT round(po, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1, round((po - pe) / (1 - pe), 6) AS kappa FROM m""")
def accuracy_metrics(spark: S, sf: str) -> D:
    m = validate.accuracy_metrics(_pairs(spark, sf))
    return m.select(*[r(c).alias(c) for c in m.columns])


@register(f"SELECT CAST(truth AS INT) AS truth, CAST(pred AS INT) AS pred, count(*) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM labels), 6) AS percent FROM ({PAIRS}) GROUP BY 1, 2")
def confusion_percent(spark: S, sf: str) -> D:
    c = validate.confusion_percent(_pairs(spark, sf))
    return c.select("truth", "pred", "n", r("percent").alias("percent"))


CA = "c AS (SELECT doc_id % 7 AS area, quality AS truth, toxic AS pred FROM labels), n AS (SELECT area, count(*)::DOUBLE AS n, count(*) FILTER (WHERE truth = 1)::DOUBLE AS t, count(*) FILTER (WHERE pred = 1)::DOUBLE AS p, count(*) FILTER (WHERE truth = 1 AND pred = 1)::DOUBLE AS b FROM c GROUP BY 1)"


def _pairs_by_area(spark: S, sf: str) -> D:
    one = v.table(spark, sf, "labels").select((F.col("doc_id") % 7).alias("area"), F.col("doc_id").alias("row"), F.lit(0).alias("col"), "quality", "toxic")
    side = lambda c: one.select("area", "row", "col", F.col(c).alias("value"))
    return validate.compared(side("quality"), side("toxic"), keys=("area",))


@register(f"""WITH {CA}, k AS (SELECT *, (n - t - p + 2 * b) / n AS po, ((n - t) * (n - p) + t * p) / (n * n) AS pe FROM n)
  SELECT area, (n - t - p + b)::BIGINT AS c00, (p - b)::BIGINT AS c01, (t - b)::BIGINT AS c10, b::BIGINT AS c11, round(po, 6) AS accuracy, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM k""")
def accuracy_by_area(spark: S, sf: str) -> D:
    """Counts and measures of several areas in one job."""
    pairs = _pairs_by_area(spark, sf)
    measures = validate.accuracy_metrics(pairs, ("area",)).select("area", r("accuracy").alias("accuracy"), r("kappa").alias("kappa"))
    return validate.confusion_matrix(pairs, ("area",)).join(measures, "area")


@register("SELECT doc_id % 7 AS area, quality::INT AS truth, toxic::INT AS pred, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY doc_id % 7), 6) AS percent FROM labels GROUP BY 1, 2, 3")
def percent_by_area(spark: S, sf: str) -> D:
    return validate.confusion_percent(_pairs_by_area(spark, sf), ("area",)).select("area", "truth", "pred", "n", r("percent").alias("percent"))


CODES = tuple(scalar.LANDCOVER)


@register("SELECT p_partkey, name, rgba FROM part JOIN (VALUES " + ", ".join(f"({i}, '{name}', '{','.join(map(str, rgba))}')" for i, (name, rgba) in enumerate(scalar.LANDCOVER.values())) + ") c(i, name, rgba) ON p_size % 12 = i")
def landcover_label(spark: S, sf: str) -> D:
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("p_size") % 12 + 1).cast("int"))
    p = v.table(spark, sf, "part").select("p_partkey", scalar.landcover_label(code).alias("c"))
    return p.select("p_partkey", "c.name", F.array_join(F.col("c.rgba").cast("array<string>"), ",").alias("rgba"))



@register("SELECT CAST(p_size % 6 * 10 AS INT) AS code, count(*) AS n, CASE p_size % 6 WHEN 1 THEN 'Tree cover' WHEN 2 THEN 'Shrubland' WHEN 3 THEN 'Grassland' WHEN 4 THEN 'Cropland' WHEN 5 THEN 'Built-up' ELSE 'No data' END AS name FROM part GROUP BY 1, 3")
def landcover_classes(spark: S, sf: str) -> D:
    return raster.landcover_classes(v.table(spark, sf, "part").select((F.col("p_size") % 6 * 10).cast("int").alias("code")), {k: name for k, (name, _) in scalar.LANDCOVER.items()})


# -- rasters -----------------------------------------------------------------------------------


@register(f"WITH {v.BAND} SELECT row, col FROM band WHERE col BETWEEN 20 AND 80 AND row BETWEEN 2 AND 40")
def clip_to_bounds(spark: S, sf: str) -> D:
    b = v.band(spark, sf).withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})
    return raster.clip_to_bounds(b, 20, 2, 80, 40).select("row", "col")


@register(f"WITH {v.BAND} SELECT row, col FROM band WHERE col + 0.5 > 10 AND col + 0.5 < 100 AND row + 0.5 < 50 AND (row + 0.5e0) > (col + 0.5e0 - 10) * 50 / 90")
def clip_to_ring(spark: S, sf: str) -> D:
    b = v.band(spark, sf).withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5})
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
    return raster.clip_to_ring(b, F.array(corner(10, 0), corner(100, 50), corner(10, 50))).select("row", "col")


@register(f"""WITH {v.BAND}, p AS (SELECT CAST(s_suppkey * 11 % 118 AS DOUBLE) + 0.25e0 AS x0, CAST(s_suppkey * 5 % 90 AS DOUBLE) + 0.25e0 AS y0 FROM supplier)
  SELECT DISTINCT row, col FROM band JOIN p ON (col + 0.5 - x0) > 0 AND (row + 0.5 - y0) > 0 AND (col + 0.5 - x0) / 6 + (row + 0.5 - y0) / 8 < 1""")
def clip_to_area(spark: S, sf: str) -> D:
    """Pixels in any of many triangles, one per supplier, found by scan lines."""
    k = F.col("s_suppkey")
    x, y = (k * 11 % 118).cast("double") + 0.25, (k * 5 % 90).cast("double") + 0.25
    corner = lambda a, b: F.struct((x + a).alias("lon"), (y + b).alias("lat"))
    area = v.table(spark, sf, "supplier").select(F.array(corner(0, 0), corner(6, 0), corner(0, 8)).alias("ring"))
    return raster.clip_to_area(v.band(spark, sf), area, 0.5, 0.5, 1.0, 1.0).select("row", "col")


@register(f"WITH {v.STACK}, s AS (SELECT row, col, CASE WHEN time = 7 AND (row + col) % 3 = 0 THEN vv END AS vv FROM stack) SELECT row, col, count(*) AS n FROM s WHERE row IN (SELECT row FROM s WHERE vv IS NOT NULL) AND col IN (SELECT col FROM s WHERE vv IS NOT NULL) GROUP BY 1, 2")
def drop_empty_lines(spark: S, sf: str) -> D:
    s = v.stack(spark, sf).select("row", "col", F.when((F.col("time") == 7) & ((F.col("row") + F.col("col")) % 3 == 0), F.col("vv")).alias("vv"))
    return raster.drop_empty_lines(s, "vv").groupBy("row", "col").agg(F.count("*").alias("n"))


@register(f"WITH {v.BAND}, p AS (SELECT row, col, 39e0 + row * 0.01e0 AS lat, 21e0 + col * 0.01e0 AS lon FROM band) SELECT 'row' AS axis, row AS place, round(avg(lat), 6) AS mean FROM p GROUP BY 2 UNION ALL SELECT 'col', col, round(avg(lon), 6) FROM p GROUP BY 2")
def axis_vectors(spark: S, sf: str) -> D:
    p = v.band(spark, sf).withColumns({"lat": 39.0 + F.col("row") * 0.01, "lon": 21.0 + F.col("col") * 0.01})
    return raster.axis_vectors(p).select("axis", "place", r("mean").alias("mean"))


@register(f"WITH {v.BAND} SELECT CAST(row // 6 AS INT) AS crow, CAST(col // 6 AS INT) AS ccol, max(t) AS t FROM band GROUP BY 1, 2")
def coarsen_max(spark: S, sf: str) -> D:
    return raster.coarsen_max(v.band(spark, sf), "t")


SLOPE = """n AS (SELECT a.row, a.col, count(*) AS n, sum(b.z * CASE b.col - a.col WHEN 0 THEN 0 ELSE (b.col - a.col) * CASE WHEN b.row = a.row THEN 2e0 ELSE 1e0 END END) AS gx,
    sum(b.z * CASE b.row - a.row WHEN 0 THEN 0 ELSE (b.row - a.row) * CASE WHEN b.col = a.col THEN 2e0 ELSE 1e0 END END) AS gy
  FROM g a JOIN g b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2),
  slope AS (SELECT row, col, CASE WHEN n = 9 THEN degrees(atan(sqrt(pow(gx / (8 * CX), 2) + pow(gy / (8 * CY), 2)))) END AS slope FROM n)"""


@register(f"WITH {v.STATIC}, g AS (SELECT row, col, dem AS z FROM static), {SLOPE} SELECT row, col, round(slope, 5) AS slope FROM slope".replace("CX", "10e0").replace("CY", "10e0"))
def slope(spark: S, sf: str) -> D:
    return raster.slope(v.static(spark, sf), 10.0, 10.0).select("row", "col", r("slope", 5).alias("slope"))


@register(f"WITH {v.STATIC}, g AS (SELECT row // 6 AS row, col // 6 AS col, max(dem) AS z FROM static GROUP BY 1, 2), {SLOPE} SELECT p.row, p.col, round(slope, 5) AS slope, coalesce(slope < 60, false) AS slope_mask FROM static p LEFT JOIN slope s ON p.row // 6 = s.row AND p.col // 6 = s.col".replace("CX", "60e0").replace("CY", "60e0"))
def slope_mask(spark: S, sf: str) -> D:
    return raster.slope_mask(v.static(spark, sf), 10.0, 10.0, limit=60.0).select("row", "col", r("slope", 5).alias("slope"), "slope_mask")


TARGET = f"{v.BAND}, tgt AS (SELECT row, col, 0.3e0 + col * 0.7e0 AS x, 0.2e0 + row * 0.6e0 AS y FROM band)"


def _target(spark: S, sf: str) -> D:
    return v.band(spark, sf).select("row", "col", (0.3 + F.col("col") * 0.7).alias("x"), (0.2 + F.col("row") * 0.6).alias("y"))


@register(f"WITH {TARGET} SELECT g.row, g.col, b.t FROM tgt g LEFT JOIN band b ON b.row = CAST(floor(g.y + 0.5) AS INT) AND b.col = CAST(floor(g.x + 0.5) AS INT)")
def resample_nearest(spark: S, sf: str) -> D:
    return raster.resample_nearest(v.band(spark, sf), _target(spark, sf), 0.0, 0.0, 1.0, 1.0, "t").select("row", "col", "t")


@register(f"""WITH {TARGET}, k AS (SELECT g.row, g.col, y - floor(y) AS fy, x - floor(x) AS fx, CAST(floor(y) AS INT) + a AS r, CAST(floor(x) AS INT) + b AS c, a, b FROM tgt g, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
  w AS (SELECT row, col, r, c, CASE WHEN a = 0 THEN 1 - fy ELSE fy END * CASE WHEN b = 0 THEN 1 - fx ELSE fx END AS w FROM k)
  SELECT w.row, w.col, round(coalesce(sum(w * t) / sum(CASE WHEN t IS NOT NULL THEN w END), -9999), 6) AS t FROM w LEFT JOIN band b ON b.row = r AND b.col = c WHERE w > 0 GROUP BY 1, 2""")
def resample_bilinear(spark: S, sf: str) -> D:
    return raster.resample_bilinear(v.band(spark, sf), _target(spark, sf), 0.0, 0.0, 1.0, 1.0, "t").select("row", "col", r("t").alias("t"))


@register("SELECT CAST(l_partkey // 50 AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col, min(CASE WHEN i = 1 THEN l_linenumber END) AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_linenumber) AS i FROM lineitem WHERE l_linenumber <> 3) GROUP BY 1, 2")
def mosaic_tiles(spark: S, sf: str) -> D:
    at = v.pixel("l_partkey", 50)
    tiles = v.table(spark, sf, "lineitem").select(at["row"].alias("row"), at["col"].alias("col"), F.struct("l_suppkey", "l_linenumber").alias("tile"), F.col("l_linenumber").alias("value"))
    return raster.mosaic_tiles(tiles, nodata=3)


@register(f"""WITH {v.BAND}, p AS (SELECT s_suppkey AS place, s_nationkey AS attr, CAST(s_suppkey * 7 % 110 AS DOUBLE) AS x0, CAST(s_suppkey * 3 % 60 AS DOUBLE) AS y0 FROM supplier)
  SELECT b.row, b.col, h.attr FROM band b LEFT JOIN (SELECT row, col, attr FROM band JOIN p ON col + 0.5 > x0 AND col + 0.5 < x0 + 12 AND row + 0.5 > y0 AND row + 0.5 < y0 + 9 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY place DESC) = 1) h ON b.row = h.row AND b.col = h.col""")
def rasterize_polygons(spark: S, sf: str) -> D:
    k = F.col("s_suppkey")
    x, y = (k * 7 % 110).cast("double"), (k * 3 % 60).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("lon"), (y + b).alias("lat"))
    polygons = v.table(spark, sf, "supplier").select(k.alias("place"), F.col("s_nationkey").alias("attr"), F.array(corner(0, 0), corner(12, 0), corner(12, 9), corner(0, 9), corner(0, 0)).alias("ring"))
    grid = v.band(spark, sf).select("row", "col")
    return raster.rasterize_polygons(grid, polygons, 0.5, 0.5, 1.0, 1.0)


@register("SELECT c_custkey FROM customer WHERE c_custkey % 100 <= 40 AND c_custkey % 100 + 3 >= 10 AND c_custkey % 77 <= 30 AND c_custkey % 77 + 3 >= 5")
def tiles_for_aoi(spark: S, sf: str) -> D:
    k = F.col("c_custkey")
    tiles = v.table(spark, sf, "customer").select("c_custkey", (k % 100).alias("lon_min"), (k % 100 + 3).alias("lon_max"), (k % 77).alias("lat_min"), (k % 77 + 3).alias("lat_max"))
    return raster.tiles_for_aoi(tiles, scalar.ring_bounds(scalar.bbox_ring(10, 5, 40, 30))).select("c_custkey")


@register(f"WITH {v.BAND} SELECT row, count(*) AS n, md5(string_agg(CAST(CAST(round(t * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY col)) AS digest FROM band GROUP BY 1")
def raster_rows(spark: S, sf: str) -> D:
    whole = v.band(spark, sf).select("row", "col", F.round(F.col("t") * 1000).cast("long").alias("v"))
    return raster.raster_rows(whole).select("row", F.size("values").cast("long").alias("n"), F.md5(F.array_join(F.col("values").cast("array<string>"), ",")).alias("digest"))


@register(f"WITH {v.BAND} SELECT row, col, t FROM band")
def chip_round_trip(spark: S, sf: str) -> D:
    """Long form to chips and back."""
    c = raster.chips(v.band(spark, sf), "t", 25)
    return c.select(F.explode("cells").alias("x")).select("x.row", "x.col", F.col("x.v").alias("t"))


@register(f"WITH {v.STACK} SELECT row, col, round(max(CASE WHEN time = 7 THEN vv END), 12) AS post, round(max(CASE WHEN time = 6 THEN vv END), 12) AS pre1, round(max(CASE WHEN time = 5 THEN vv END), 12) AS pre2 FROM stack WHERE time >= 5 GROUP BY 1, 2")
def last_three(spark: S, sf: str) -> D:
    s = raster.last_times(v.stack(spark, sf))
    at = lambda k: r(F.max(F.when(F.col("back") == k, F.col("vv"))), 12)
    return s.groupBy("row", "col").agg(at(1).alias("post"), at(2).alias("pre1"), at(3).alias("pre2"))


# -- neighbourhoods ----------------------------------------------------------------------------


@register(f"WITH {v.BAND} SELECT row, col FROM band WHERE t < -0.5 AND row % 6 = 0 AND col % 6 = 0")
def seed_grid(spark: S, sf: str) -> D:
    return delineate.seed_grid(v.band(spark, sf).withColumn("mask", F.col("t") < -0.5))


def _flood(spark: S, sf: str) -> D:
    return v.band(spark, sf).select("row", "col", (F.col("t") < -0.35).alias("flag"))


SIDES = "(0, 1), (1, 0), (0, -1), (-1, 0)"


def _regions_sql(where: str, steps: str) -> str:
    """Reach of every pixel of a condition through neighbours; a region is named by its least pixel."""
    return f"""{v.BAND}, f AS (SELECT row, col FROM band WHERE {where}), step(dr, dc) AS (VALUES {steps}),
  reach AS (SELECT row, col, row AS r0, col AS c0 FROM f UNION SELECT f.row, f.col, r0, c0 FROM reach CROSS JOIN step JOIN f ON f.row = reach.row + dr AND f.col = reach.col + dc),
  regions AS (SELECT row, col, min(CAST(r0 AS BIGINT) * 2147483648 + c0) AS region FROM reach GROUP BY 1, 2)"""


REGIONS = _regions_sql("t < -0.35", SIDES)
DARK = _regions_sql("t < -0.8", SIDES + ", (1, 1), (1, -1), (-1, 1), (-1, -1)")
#: Holes are the few background regions of a mask that covers nearly all.
HOLES = _regions_sql("NOT t < 1.5", SIDES)


@register(f"WITH RECURSIVE {HOLES}, n AS (SELECT region, count(*) AS n FROM regions GROUP BY 1) SELECT b.row, b.col, t < 1.5 OR n.n < 4 AS flag FROM band b LEFT JOIN regions r ON b.row = r.row AND b.col = r.col LEFT JOIN n ON r.region = n.region")
def fill_small_holes(spark: S, sf: str) -> D:
    return regions.fill_small_holes(v.band(spark, sf).select("row", "col", (F.col("t") < 1.5).alias("flag")), 4, tile=32)


def _dark(spark: S, sf: str) -> D:
    return v.band(spark, sf).select("row", "col", (F.col("t") < -0.8).alias("flag"))


@register(f"WITH RECURSIVE {DARK}, n AS (SELECT region, greatest(max(row) - min(row), max(col) - min(col)) + 1 AS n FROM regions GROUP BY 1) SELECT b.row, b.col, coalesce(n.n >= 4, false) AS flag FROM band b LEFT JOIN regions r ON b.row = r.row AND b.col = r.col LEFT JOIN n ON r.region = n.region")
def diameter_opening(spark: S, sf: str) -> D:
    return regions.diameter_opening(_dark(spark, sf), 4, tile=32)


@register(f"WITH RECURSIVE {DARK}, n AS (SELECT region, count(*) AS n FROM regions GROUP BY 1) SELECT b.row, b.col, coalesce(n.n >= 5, false) AS flag FROM band b LEFT JOIN regions r ON b.row = r.row AND b.col = r.col LEFT JOIN n ON r.region = n.region")
def remove_small_objects(spark: S, sf: str) -> D:
    return regions.remove_small_objects(_dark(spark, sf), 5, tile=32)


@register(f"WITH RECURSIVE {REGIONS} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, region FROM regions")
def connected_components(spark: S, sf: str) -> D:
    found = regions.connected_components(_flood(spark, sf).where("flag"), tile=32)
    return found.select("row", "col", "region")


@register()
def morphology(spark: S, sf: str) -> D:
    """Tested against plain flood fills."""
    return regions.morphology(_flood(spark, sf), unit_m2=1200, tile=32)


def _stripe_regions(name: str, pixels: str, steps: str) -> str:
    """Regions of pixels (row, col) in stripes of five rows, named by their least pixel."""
    return f"""step_{name}(dr, dc) AS (VALUES {steps}),
  reach_{name} AS (SELECT row, col, row AS r0, col AS c0 FROM ({pixels}) UNION
    SELECT f.row, f.col, r0, c0 FROM reach_{name} r CROSS JOIN step_{name} JOIN ({pixels}) f ON f.row = r.row + dr AND f.col = r.col + dc AND f.row // 5 = r.row // 5),
  {name} AS (SELECT row, col, min(CAST(r0 AS BIGINT) * 2147483648 + c0) AS region FROM reach_{name} GROUP BY 1, 2),
  size_{name} AS (SELECT region, count(*) AS n, greatest(max(row) - min(row), max(col) - min(col)) + 1 AS wide FROM {name} GROUP BY 1)"""


AROUND = SIDES + ", (1, 1), (1, -1), (-1, 1), (-1, -1)"


@register(f"""WITH RECURSIVE {v.BAND}, {_stripe_regions("holes", "SELECT row, col FROM band WHERE NOT t < -0.1", SIDES)},
  filled AS (SELECT b.row, b.col FROM band b LEFT JOIN holes h ON h.row = b.row AND h.col = b.col LEFT JOIN size_holes s ON s.region = h.region WHERE t < -0.1 OR s.n < 12),
  {_stripe_regions("wide", "SELECT row, col FROM filled", AROUND)}, opened AS (SELECT row, col FROM wide JOIN size_wide USING (region) WHERE size_wide.wide >= 3),
  {_stripe_regions("large", "SELECT row, col FROM opened", AROUND)}, kept AS (SELECT row, col FROM large JOIN size_large USING (region) WHERE n >= 6)
  SELECT b.row, b.col, CAST(b.row // 5 AS INT) AS stripe, kept.row IS NOT NULL AS flag FROM band b LEFT JOIN kept ON kept.row = b.row AND kept.col = b.col""")
def morphology_stripes(spark: S, sf: str) -> D:
    """All three steps on stripes of five rows, each a raster of its own, so that the twin can follow their regions."""
    mask = v.band(spark, sf).select("row", "col", F.floor(F.col("row") / 5).cast("int").alias("stripe"), (F.col("t") < -0.1).alias("flag"))
    return regions.morphology(mask, unit_m2=1200, tile=32, keys=("stripe",))


@register(f"""WITH RECURSIVE {REGIONS}, pairs AS (SELECT a.region, count(*) AS n FROM regions a JOIN regions b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col) GROUP BY 1),
  squares AS (SELECT a.region, count(*) AS n FROM regions a JOIN regions b ON b.row = a.row AND b.col = a.col + 1 JOIN regions c ON c.row = a.row + 1 AND c.col = a.col JOIN regions d ON d.row = a.row + 1 AND d.col = a.col + 1 GROUP BY 1)
  SELECT region, CAST(count(*) AS DOUBLE) AS area, 1 - count(*) + coalesce(any_value(pairs.n), 0) - coalesce(any_value(squares.n), 0) AS holes
  FROM regions LEFT JOIN pairs USING (region) LEFT JOIN squares USING (region) GROUP BY 1""")
def region_polygons(spark: S, sf: str) -> D:
    """Area of the rings and their holes per region; the twin counts pixels, and holes by Euler's number."""
    found = regions.connected_components(_flood(spark, sf).where("flag"), tile=32)
    return outlines.polygon_area(outlines.region_polygons(found, tile=32))


@register(f"WITH {v.BAND} SELECT (row // 40) AS flood_ts, round(count(*) * 100 / 1e6, 2) AS km2 FROM band WHERE t < -0.35 GROUP BY 1".replace("(row // 40)", "CAST(row // 40 AS INT)"))
def flooded_area(spark: S, sf: str) -> D:
    flood = _flood(spark, sf).where("flag").withColumn("flood_ts", F.floor(F.col("row") / 40).cast("int"))
    return regions.flooded_area(flood.groupBy("flood_ts").agg(F.count("*").alias("area")))


@register(f"""WITH {v.BAND}, st AS (SELECT row, col, t, t < -1.2 AS f FROM band), w AS (SELECT s.row AS sr, s.col AS sc, avg(c.t) FILTER (WHERE c.f) AS m, bool_and(c.f) AS fl FROM st s JOIN st c ON c.row BETWEEN s.row - 1 AND s.row + 1 AND c.col BETWEEN s.col - 1 AND s.col + 1 WHERE s.f GROUP BY 1, 2),
  a AS (SELECT c.row, c.col, c.t < w.m AS add FROM (SELECT * FROM w WHERE NOT fl) w JOIN st c ON c.row BETWEEN sr - 1 AND sr + 1 AND c.col BETWEEN sc - 1 AND sc + 1 QUALIFY row_number() OVER (PARTITION BY c.row, c.col ORDER BY sr DESC, sc DESC) = 1)
  SELECT st.row, st.col, f OR coalesce(add, false) AS flooded, NOT f AND coalesce(add, false) AS seed FROM st LEFT JOIN a ON st.row = a.row AND st.col = a.col""")
def growth_round(spark: S, sf: str) -> D:
    flag = F.col("t") < -1.2
    return delineate.growth_round(v.band(spark, sf).withColumns({"flooded": flag, "seed": flag})).select("row", "col", "flooded", "seed")


def _rounds_sql(rounds: int) -> str:
    """So many synchronous rounds of growth, each a step of its own."""
    out = [f"{v.BAND}", "st0 AS MATERIALIZED (SELECT row, col, t, t < -1.2 AS f, t < -1.2 AS seed FROM band)"]
    for k in range(rounds):
        near = "c.row BETWEEN {0} - 1 AND {0} + 1 AND c.col BETWEEN {1} - 1 AND {1} + 1"
        out += [
            f"w{k} AS MATERIALIZED (SELECT s.row AS sr, s.col AS sc, avg(c.t) FILTER (WHERE c.f) AS m, bool_and(c.f) AS fl FROM st{k} s JOIN st{k} c ON {near.format('s.row', 's.col')} WHERE s.seed GROUP BY 1, 2)",
            f"a{k} AS MATERIALIZED (SELECT c.row, c.col, c.t < w.m AS add FROM (SELECT * FROM w{k} WHERE NOT fl) w JOIN st{k} c ON {near.format('sr', 'sc')} QUALIFY row_number() OVER (PARTITION BY c.row, c.col ORDER BY sr DESC, sc DESC) = 1)",
            f"st{k + 1} AS MATERIALIZED (SELECT st.row, st.col, t, f OR coalesce(add, false) AS f, NOT f AND coalesce(add, false) AS seed FROM st{k} st LEFT JOIN a{k} a ON st.row = a.row AND st.col = a.col)",
        ]
    return f"WITH {', '.join(out)} SELECT row, col, f AS flooded FROM st{rounds}"


@register(_rounds_sql(9))
def region_growing_rounds(spark: S, sf: str) -> D:
    """Nine rounds, in two whole batches and a part of one."""
    b = v.band(spark, sf)
    return delineate.region_growing(b, b.withColumn("mask", F.col("t") < -1.2), max_rounds=9, tile=32, batch=4)


@register()
def region_growing(spark: S, sf: str) -> D:
    """Tested against a sequential restatement."""
    b = v.band(spark, sf)
    return delineate.region_growing(b, b.withColumn("mask", F.col("t") < -1.2), tile=32, batch=4)


@register(f"WITH {v.BAND}, m AS (SELECT row // 8 AS wr, col // 25 AS wc, median(t) AS m FROM band GROUP BY 1, 2) SELECT CAST(wr AS INT) AS wr, CAST(wc AS INT) AS wc, round(CASE WHEN m >= 0.4 THEN 0e0 WHEN m < -0.2e0 THEN 1e0 ELSE (0.4e0 - m) / 0.6e0 END, 6) AS factor FROM m")
def growth_factor(spark: S, sf: str) -> D:
    w = v.band(spark, sf).withColumns({"wr": F.floor(F.col("row") / 8).cast("int"), "wc": F.floor(F.col("col") / 25).cast("int")})
    return delineate.growth_factor(w, -0.2, 0.3, ("wr", "wc")).select("wr", "wc", r("factor").alias("factor"))


@register(f"WITH {v.BAND}, m AS (SELECT row // 8 AS wr, col // 25 AS wc, median(t) AS m, stddev_pop(t) AS s FROM band GROUP BY 1, 2) SELECT CAST(wr AS INT) AS wr, CAST(wc AS INT) AS wc, m <= 0.1 AND pow(0.1e0 - s, 2) / (0.01e0 + s * s) > 0.5 AS holds FROM m")
def darker_than(spark: S, sf: str) -> D:
    w = v.band(spark, sf).withColumns({"wr": F.floor(F.col("row") / 8).cast("int"), "wc": F.floor(F.col("col") / 25).cast("int")})
    return delineate.darker_than(w, 0.1, 0.1, ("wr", "wc"), limit=0.5)


@register(f"WITH {v.BAND}, m AS (SELECT row // 8 AS wr, col // 25 AS wc, median(t) AS m, stddev_pop(t) AS s FROM band GROUP BY 1, 2) SELECT CAST(wr AS INT) AS wr, CAST(wc AS INT) AS wc, m >= -0.1 AND pow(-0.1e0 - s, 2) / (0.01e0 + s * s) > 1.2 AS holds FROM m")
def brighter_than(spark: S, sf: str) -> D:
    w = v.band(spark, sf).withColumns({"wr": F.floor(F.col("row") / 8).cast("int"), "wc": F.floor(F.col("col") / 25).cast("int")})
    return delineate.darker_than(w, -0.1, 0.1, ("wr", "wc"), brighter=True, limit=1.2)


@register(f"""WITH {v.BAND}, s AS (SELECT col // 25 AS g, t, CASE WHEN row % 2 = 0 THEN 0 ELSE 1 END AS side FROM band), c AS (SELECT g, t, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM s GROUP BY 1, 2),
  u AS (SELECT g, sum(a) OVER w AS ra, sum(b) OVER w AS rb, sum(a) OVER (PARTITION BY g) AS n, sum(b) OVER (PARTITION BY g) AS m FROM c WINDOW w AS (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING))
  SELECT CAST(g AS INT) AS g, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(m) AS BIGINT) AS m, round(max(abs(CAST(ra AS DOUBLE) / n - CAST(rb AS DOUBLE) / m)), 6) AS d FROM u GROUP BY 1""")
def ks_distance(spark: S, sf: str) -> D:
    s = v.band(spark, sf).select(F.floor(F.col("col") / 25).cast("int").alias("g"), "t", (F.col("row") % 2).alias("side"))
    return delineate.ks_distance(s, ("g",)).select("g", "n", "m", r("d").alias("d"))


@register()
def ks_similar(spark: S, sf: str) -> D:
    """Exact p-values need a recursion per group: tested against enumerated lattice paths."""
    s = v.band(spark, sf).select(F.floor(F.col("row") / 10).cast("int").alias("g"), "t", (F.col("col") % 2).alias("side"))
    return delineate.ks_similar(s, ("g",)).select("g", r("d").alias("d"), "similar")


#: Lattice paths that stay in the band, row by row, as lists; the share that doesn't is the p-value.
PATHS = f"""{v.BAND}, s AS (SELECT row AS g, t - CASE WHEN col % 2 = 0 AND row % 3 = 0 THEN 0.7e0 ELSE 0 END AS t, CASE WHEN col % 2 = 0 THEN 0 ELSE 1 END AS side FROM band),
  c AS (SELECT g, t, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM s GROUP BY 1, 2),
  u AS (SELECT g, sum(a) OVER w AS ra, sum(b) OVER w AS rb, sum(a) OVER (PARTITION BY g) AS n, sum(b) OVER (PARTITION BY g) AS m FROM c WINDOW w AS (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT g, any_value(n)::BIGINT AS n, any_value(m)::BIGINT AS m, max(abs(ra::DOUBLE / n - rb::DOUBLE / m)) AS d FROM u WHERE n > 0 AND m > 0 GROUP BY 1),
  p(g, n, m, d, i, line) AS (SELECT g, n, m, d, 0, list_transform(range(m + 1), lambda j: CASE WHEN j * n < d * n * m - 0.5 THEN 1e0 ELSE 0e0 END) FROM k
    UNION ALL SELECT g, n, m, d, i + 1, list_transform(range(m + 1), lambda j: CASE WHEN abs((i + 1) * m - j * n) < d * n * m - 0.5 THEN
      list_sum(list_transform(range(j + 1), lambda h: CASE WHEN abs((i + 1) * m - h * n) < d * n * m - 0.5 THEN line[h + 1] ELSE 0e0 END)) ELSE 0e0 END) FROM p WHERE i < n)"""


@register(f"WITH RECURSIVE {PATHS} SELECT g, round(d, 6) AS d, 1 - line[m + 1] / exp(lgamma(n + m + 1) - lgamma(n + 1) - lgamma(m + 1)) >= 0.05e0 AS similar FROM p WHERE i = n")
def ks_similar_rows(spark: S, sf: str) -> D:
    """Even against odd columns of each row, a third of the rows shifted; the twin counts lattice paths."""
    shifted = F.col("t") - F.when((F.col("col") % 2 == 0) & (F.col("row") % 3 == 0), 0.7).otherwise(0.0)
    s = v.band(spark, sf).select(F.col("row").alias("g"), shifted.alias("t"), (F.col("col") % 2).alias("side"))
    return delineate.ks_similar(s, ("g",)).where("d is not null").select("g", r("d").alias("d"), "similar")


@register(f"""WITH {v.BAND}, o AS (SELECT col // 25 AS g, avg(t) AS mu, stddev_pop(t) AS s, min(t) AS lo, max(t) AS hi FROM band GROUP BY 1), x AS (SELECT g, mu, s, lo + i * (hi - lo) / 99e0 AS x FROM o, (SELECT unnest(range(100)) AS i)),
  b AS (SELECT g, exp(-0.5e0 * pow((x - mu) / s, 2)) / s + 1e-300 AS p, exp(-0.5e0 * pow((x - 0.1e0) / 0.9e0, 2)) / 0.9e0 + 1e-300 AS q FROM x), t AS (SELECT g, sum(p) AS sp, sum(q) AS sq FROM b GROUP BY 1)
  SELECT CAST(b.g AS INT) AS g, round(sum((p / sp - q / sq) * ln((p / sp) / (q / sq))), 6) AS divergence FROM b JOIN t ON b.g = t.g GROUP BY 1""")
def gaussian_similar(spark: S, sf: str) -> D:
    w = v.band(spark, sf).withColumn("g", F.floor(F.col("col") / 25).cast("int"))
    return delineate.gaussian_similar(w, 0.1, 0.9, ("g",)).select("g", r("divergence").alias("divergence"))


@register(f"""WITH {v.BAND}, w AS (SELECT row // 5 AS a, col // 5 AS b, sum(CASE WHEN t < 0 THEN 1 ELSE 0 END) AS v FROM band GROUP BY 1, 2)
  SELECT row, col, round(v / (26e0), 6) AS probability, v / 26e0 > 0.25 AS flooded FROM band JOIN w ON row // 5 = a AND col // 5 = b""")
def vote_probability(spark: S, sf: str) -> D:
    b = v.band(spark, sf).withColumns({"a": F.floor(F.col("row") / 5), "b": F.floor(F.col("col") / 5)})
    sums = b.groupBy("a", "b").agg(F.sum((F.col("t") < 0).cast("long")).alias("votes"))
    votes = b.join(sums, ["a", "b"]).select("row", "col", "votes", F.lit(25).cast("long").alias("visits"))
    return delineate.vote_probability(b, votes).select("row", "col", r("probability").alias("probability"), "flooded")


BLOCKS = delineate.FloodParams(sizes=(10, 20, 25), smoothing=False, least_pixels=20, bimodality=0.5)


def _block_sql(size: int) -> str:
    return f"""SELECT {size} AS size, row // {size} AS "by", col // {size} AS bx, t FROM band"""


@register(f"""WITH {v.BAND}, b AS ({' UNION ALL '.join(_block_sql(s) for s in (10, 20, 25))}), m AS (SELECT size, "by", bx, count(*) AS n, avg(t) AS mu FROM b GROUP BY 1, 2, 3),
  z AS (SELECT b.size, b."by", b.bx, any_value(n) AS n, any_value(mu) AS mu, avg(pow(t - mu, 2)) AS m2, avg(pow(t - mu, 3)) AS m3, avg(pow(t - mu, 4)) AS m4 FROM b JOIN m ON b.size = m.size AND b."by" = m."by" AND b.bx = m.bx GROUP BY 1, 2, 3)
  SELECT CAST(size AS INT) AS size, CAST("by" AS INT) AS "by", CAST(bx AS INT) AS bx, CASE WHEN n >= 20 THEN round((pow(m3 / pow(m2, 1.5e0), 2) + 1) / (m4 / (m2 * m2) - 3 + 3e0 * (n - 1) * (n - 1) / ((n - 2e0) * (n - 3e0))), 6) END AS bc, round(mu, 11) AS mean FROM z""")
def block_bimodality(spark: S, sf: str) -> D:
    return delineate.block_bimodality(v.band(spark, sf), BLOCKS).select("size", "by", "bx", r("bc").alias("bc"), r("mean", 11).alias("mean"))


#: Blocks smoothed along columns and then rows, each with the weights of its mirrored reach; a value is missing where its reach has a gap.
SMOOTHED = f"""{v.BAND}, s AS (SELECT unnest([25, 50, 100]) AS n), px AS (SELECT n, row // n AS by_, col // n AS bx, row % n AS i, col % n AS j, t FROM band, s),
  taps AS (SELECT o, exp(-0.5e0 * o * o / 25) / sum(exp(-0.5e0 * o * o / 25)) OVER () AS w FROM (SELECT unnest(range(-20, 21)) AS o)),
  k AS (SELECT n, i, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS j, sum(w) AS w FROM (SELECT n, i, ((i + o) % (2 * n) + 2 * n) % (2 * n) AS m, w FROM (SELECT n, unnest(range(n)) AS i FROM s), taps) GROUP BY 1, 2, 3),
  kc AS (SELECT n, i, count(*) AS c FROM k GROUP BY 1, 2),
  a AS (SELECT px.n, by_, bx, px.i, k.i AS j, sum(k.w * t) AS v, count(t) AS c FROM px JOIN k ON k.n = px.n AND k.j = px.j GROUP BY 1, 2, 3, 4, 5),
  a2 AS (SELECT a.n, by_, bx, a.i, a.j, v FROM a JOIN kc ON kc.n = a.n AND kc.i = a.j AND kc.c = a.c),
  b AS (SELECT a2.n, by_, bx, k.i, a2.j, sum(k.w * v) AS v, count(*) AS c FROM a2 JOIN k ON k.n = a2.n AND k.j = a2.i GROUP BY 1, 2, 3, 4, 5),
  b2 AS (SELECT b.n, by_, bx, v FROM b JOIN kc ON kc.n = b.n AND kc.i = b.i AND kc.c = b.c),
  m AS (SELECT n, by_, bx, count(*) AS q, avg(v) AS mu FROM b2 GROUP BY 1, 2, 3),
  z AS (SELECT b2.n, b2.by_, b2.bx, any_value(q) AS q, avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4 FROM b2 JOIN m ON b2.n = m.n AND b2.by_ = m.by_ AND b2.bx = m.bx GROUP BY 1, 2, 3),
  f AS (SELECT z.n, z.by_, z.bx, q >= 100 AND (pow(m3 / pow(m2, 1.5e0), 2) + 1) / (m4 / (m2 * m2) - 3 + 3e0 * (q - 1) * (q - 1) / ((q - 2e0) * (q - 3e0))) > LIMIT AND mean < 0 AS flagged
    FROM z JOIN (SELECT n, by_, bx, avg(t) AS mean FROM px GROUP BY 1, 2, 3) r ON r.n = z.n AND r.by_ = z.by_ AND r.bx = z.bx),
  h AS (SELECT px.n, by_ * px.n + i AS row, bx * px.n + j AS col, coalesce(flagged, false) AS flagged FROM px LEFT JOIN f USING (n, by_, bx)),
  c AS (SELECT row, col, count(*) FILTER (WHERE flagged) / 3e0 > VOTE AS chosen FROM h GROUP BY 1, 2)"""
MASKED = "SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, CASE WHEN (SELECT bool_or(chosen) FROM c) THEN chosen ELSE true END AS mask FROM c"


@register(f"WITH {SMOOTHED} {MASKED}".replace("LIMIT", "0.555e0").replace("VOTE", "0.1e0"))
def bimodality_mask(spark: S, sf: str) -> D:
    """Smoothed blocks at the published limits."""
    return delineate.bimodality_mask(v.band(spark, sf), delineate.FloodParams(sizes=(25, 50, 100)))


@register(f"WITH {SMOOTHED} {MASKED}".replace("LIMIT", "0.42e0").replace("VOTE", "0.4e0"))
def bimodality_votes(spark: S, sf: str) -> D:
    """Smoothed blocks at a lower limit, two votes of three needed."""
    return delineate.bimodality_mask(v.band(spark, sf), delineate.FloodParams(sizes=(25, 50, 100), bimodality=0.42, vote=0.4))


@register()
def adaptive_threshold(spark: S, sf: str) -> D:
    """Tested against one window per seed, whatever the tiles."""
    b = v.band(spark, sf)
    p = delineate.FloodParams(halves=(8, 12), local_bimodality=0.45, unit_m2=14400, tile=64)
    return delineate.adaptive_threshold(b, b.withColumn("mask", F.col("t") < -0.5), -1.0, 0.3, p).select("row", "col", r("probability").alias("probability"), "flooded")


# -- patches -----------------------------------------------------------------------------------


@register(f"""WITH {v.BAND}, p AS (SELECT o AS "offset", (row - o) // 16 AS py, (col - o) // 16 AS px, count(*) AS n, sum(CAST(round(t * 1000) AS BIGINT)) AS s,
    md5(string_agg(CAST(CAST(round(t * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY row, col)) AS digest FROM band, (SELECT unnest([0, 4, 8]) AS o) WHERE row >= o AND col >= o GROUP BY 1, 2, 3)
  SELECT CAST("offset" AS INT) AS "offset", CAST(py AS INT) AS py, CAST(px AS INT) AS px, CAST(s AS BIGINT) AS s, digest FROM p WHERE n = 256""")
def patch_dataset(spark: S, sf: str) -> D:
    b = v.band(spark, sf).select("row", "col", F.round(F.col("t") * 1000).cast("long").alias("t"))
    p = patches.patch_dataset(b, ("t",), 16, (0, 4, 8))
    total = F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x)
    return p.select("offset", "py", "px", total.alias("s"), F.md5(F.array_join(F.col("t").cast("array<string>"), ",")).alias("digest"))


def _threshold_scorer():
    """A stand-in for a model: class 2 below -0.5, 1 below 0, else 0."""
    return lambda x: (x[:, 0] < 0).astype(int) + (x[:, 0] < -0.5)


@register(f"""WITH {v.BAND}, e AS (SELECT o, (row - o) // 16 AS py, (col - o) // 16 AS px, row, col, t, count(*) OVER (PARTITION BY o, (row - o) // 16, (col - o) // 16) AS n FROM band, (SELECT unnest([0, 4, 8]) AS o) WHERE row >= o AND col >= o),
  c AS (SELECT row, col, median(CASE WHEN t < -0.5 THEN 2 WHEN t < 0 THEN 1 ELSE 0 END) AS cls FROM e WHERE n = 256 GROUP BY 1, 2) SELECT b.row, b.col, coalesce(cls = 2, false) AS flooded FROM band b LEFT JOIN c ON b.row = c.row AND b.col = c.col""")
def vote_classes(spark: S, sf: str) -> D:
    b = v.band(spark, sf)
    classes = patches.predict_patches(patches.patch_dataset(b, ("t",), 16, (0, 4, 8)), ("t",), _threshold_scorer, 16)
    return patches.vote_classes(classes, b).select("row", "col", "flooded")


@register(f"""WITH {v.BAND}, a AS (SELECT row // 6 AS area, row % 6 AS row, col, t FROM band),
  e AS (SELECT o, area, row, col, t, count(*) OVER (PARTITION BY area, o, (row - o) // 4, (col - o) // 4) AS n FROM a, (SELECT unnest([0, 2]) AS o) WHERE row >= o AND col >= o),
  c AS (SELECT area, row, col, median(CASE WHEN t < -0.5 THEN 2 WHEN t < 0 THEN 1 ELSE 0 END) AS cls FROM e WHERE n = 16 GROUP BY 1, 2, 3)
  SELECT a.area, a.row, a.col, c.cls, coalesce(cls = 2, false) AS flooded FROM a LEFT JOIN c ON a.area = c.area AND a.row = c.row AND a.col = c.col""")
def votes_by_area(spark: S, sf: str) -> D:
    """Strips of six rows as areas of their own: patches and votes don't cross them."""
    b = v.band(spark, sf).select(F.floor(F.col("row") / 6).cast("int").alias("area"), (F.col("row") % 6).alias("row"), "col", "t")
    cut = patches.patch_dataset(b, ("t",), 4, (0, 2), ("area",))
    classes = patches.predict_patches(cut, ("t",), _threshold_scorer, 4, ("area",))
    return patches.vote_classes(classes, b, keys=("area",)).select("area", "row", "col", "cls", "flooded")


@register(f"WITH {v.STACK}, {v.STATIC} SELECT s.row, s.col, count(*) AS n, round(sum(vv * lia), 11) AS weighed, any_value(lia) AS lia FROM stack s JOIN static t ON s.row = t.row AND s.col = t.col GROUP BY 1, 2")
def pixel_join(spark: S, sf: str) -> D:
    """Stack and static fields from tables in buckets of pixels: joined and grouped without a shuffle."""
    held, fields = raster.pixel_table(v.stack(spark, sf)), raster.pixel_table(v.static(spark, sf))
    met = held.join(fields, ["row", "col"]).groupBy("row", "col")
    return met.agg(F.count("*").alias("n"), r(F.sum(F.col("vv") * F.col("lia")), 11).alias("weighed"), F.first("lia").alias("lia"))


# -- slices ------------------------------------------------------------------------------------


def _slices(spark: S, sf: str) -> tuple[D, D]:
    """Scenes and pixels of a stack whose times come in slices: the second one starts ten rows before the first ends.

    Time 3 has its slices two hours apart, which are two images; time 6 has a third slice.
    """
    s = v.stack(spark, sf).select("time", "row", "col", "vv", "vh")
    cut_row = s.agg(F.floor(F.max("row") / 2).cast("int").alias("c"))
    placed = s.crossJoin(F.broadcast(cut_row))  # one row
    here = F.array(
        F.when(F.col("row") < F.col("c") + 5, F.struct(F.lit(0).alias("k"), F.col("vv").alias("vv"), F.col("vh").alias("vh"))),
        F.when(F.col("row") >= F.col("c") - 5, F.struct(F.lit(1).alias("k"), (F.col("vv") + 1).alias("vv"), F.when(F.col("col") % 7 > 0, F.col("vh") + 2).alias("vh"))),
        F.when((F.col("time") == 6) & (F.col("row") < 3), F.struct(F.lit(2).alias("k"), F.col("vv").alias("vv"), F.col("vh").alias("vh"))),
    )
    pixels = placed.select("time", "row", "col", F.explode(F.filter(here, lambda x: x.isNotNull())).alias("x")).select(
        "time", "x.k", (F.col("time") * 10 + F.col("x.k")).alias("scene_id"), "row", "col", "x.vv", "x.vh"
    )
    second = F.when(F.col("time") == 3, F.lit(7200)).otherwise(F.lit(25))
    start = F.lit("2024-05-01 10:00:00").cast("timestamp") + F.make_dt_interval(days=F.col("time"), secs=(F.col("k") * second).cast("double"))
    return pixels.select("scene_id", (F.col("time") % 2).alias("track"), start.alias("start")).distinct(), pixels.select("scene_id", "row", "col", "vv", "vh")


SLICES = f"""{v.STACK}, cutrow AS (SELECT CAST(floor(max(row) / 2) AS INT) AS c FROM stack), px AS (
  SELECT time, 0 AS k, row, col, vv, vh FROM stack, cutrow WHERE row < c + 5
  UNION ALL SELECT time, 1, row, col, vv + 1, CASE WHEN col % 7 > 0 THEN vh + 2 END FROM stack, cutrow WHERE row >= c - 5
  UNION ALL SELECT time, 2, row, col, vv, vh FROM stack WHERE time = 6 AND row < 3),
  sc AS (SELECT DISTINCT time, k, CAST(time % 2 AS INT) AS track, TIMESTAMP '2024-05-01 10:00:00' + to_days(CAST(time AS INT)) + to_seconds(k * CASE WHEN time = 3 THEN 7200 ELSE 25 END) AS start FROM px),
  im AS (SELECT *, CASE WHEN time = 3 THEN k ELSE 0 END AS image FROM sc),
  pl AS (SELECT track, time, image, make_timestamp(CAST(round(avg(epoch_us(start))) AS BIGINT)) AS image_ts, count(*) AS n_slices FROM im GROUP BY 1, 2, 3)"""


@register(f"WITH {SLICES} SELECT track, image_ts, n_slices, n_slices <= 2 AS supported, (SELECT string_agg(time * 10 + k, ',' ORDER BY start) FROM im WHERE im.time = pl.time AND im.image = pl.image) AS slices FROM pl")
def slice_plan(spark: S, sf: str) -> D:
    plan = slices.slice_plan(_slices(spark, sf)[0].withColumn("track", F.col("track").cast("int")), ("track",))
    return plan.withColumn("slices", F.array_join(F.col("slices").cast("array<string>"), ","))


@register(f"""WITH {SLICES} SELECT image_ts, row, col, round(arg_min(vv, k) FILTER (WHERE vv IS NOT NULL), 12) AS vv, round(arg_min(vh, k) FILTER (WHERE vh IS NOT NULL), 12) AS vh, any_value(n_slices) AS n_slices
  FROM px JOIN im USING (time, k) JOIN pl USING (time, image) WHERE n_slices <= 2 GROUP BY 1, 2, 3""")
def assemble_slices(spark: S, sf: str) -> D:
    scenes, pixels = _slices(spark, sf)
    got = slices.assemble_slices(pixels, slices.slice_plan(scenes, ("track",)), ("vv", "vh"), keys=("track",))
    return got.select("image_ts", "row", "col", r("vv", 12).alias("vv"), r("vh", 12).alias("vh"), "n_slices")


@register(f"""WITH {SLICES}, e AS (SELECT time, image, k, min(row) AS r0, max(row) AS r1 FROM px JOIN im USING (time, k) GROUP BY 1, 2, 3), h AS (SELECT time, image, max(r0) AS a, min(r1) AS b FROM e GROUP BY 1, 2),
  w AS (SELECT image_ts, n_slices, row, col, vv, vh, CASE WHEN n_slices = 1 THEN 1e0 ELSE abs(1 - k - least(1, greatest(0, (row - a + 0.5e0) / (b - a + 1)))) END AS w
    FROM px JOIN im USING (time, k) JOIN pl USING (time, image) JOIN h USING (time, image) WHERE n_slices <= 2)
  SELECT image_ts, row, col, round(sum(w * vv) / sum(w), 13) AS vv, round(coalesce(sum(w * vh) / nullif(sum(w) FILTER (WHERE vh IS NOT NULL), 0), avg(vh)), 13) AS vh, any_value(n_slices) AS n_slices FROM w GROUP BY 1, 2, 3""")
def feather_slices(spark: S, sf: str) -> D:
    """The seam goes over from the first slice to the second along ten rows."""
    scenes, pixels = _slices(spark, sf)
    got = slices.assemble_slices(pixels, slices.slice_plan(scenes, ("track",)), ("vv", "vh"), "feather", ("track",))
    return got.select("image_ts", "row", "col", r("vv", 13).alias("vv"), r("vh", 13).alias("vh"), "n_slices")
