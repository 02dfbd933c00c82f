"""Registered queries that go through files: catalogue JSON, CSV, XML, text, GeoJSON, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.operators import catalogue, outlines, rainfall, raster, regions
from inundata.plans import views as v
from inundata.plans.registry import register
from inundata.sources import files
from inundata.sources.folders import fresh


@register(f"WITH {v.PRODUCTS} SELECT CAST(id AS VARCHAR) AS id, published, ptype AS product_type, CAST(lon AS DOUBLE) AS lon FROM products")
def read_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue answers of up to an hour each, written as JSON and read again."""
    p = v.products(spark, sf).withColumn("Id", F.col("Id").cast("string")).withColumn("Name", F.concat(F.lit("P"), F.col("Id")))
    answers = p.groupBy(F.date_trunc("hour", "PublicationDate").alias("hour")).agg(
        F.collect_list(F.struct("Id", "Name", F.date_format("PublicationDate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("PublicationDate"), "Attributes", "GeoFootprint")).alias("value")
    )
    path = fresh(spark, "catalogue")
    answers.select("value").write.json(path)
    got = files.read_catalogue(spark, path)
    kind = F.element_at(F.filter("Attributes", lambda a: a["Name"] == "productType"), 1)["Value"]
    return got.select(F.col("Id").alias("id"), F.col("PublicationDate").alias("published"), kind.alias("product_type"), F.col("GeoFootprint.coordinates")[0][0][0].alias("lon"))


@register(f"WITH {v.STACK} SELECT time, count(*) AS n, round(sum(nullif(vv, 0)), 4) AS vv FROM stack GROUP BY 1")
def write_stack(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of two halves of the times, written as one stack and read again."""
    s = v.stack(spark, sf).select("time", "row", "col", "vv", "vh")
    path = fresh(spark, "stack")
    files.write_stack([s.where("time < 4"), s.where("time >= 4")], path)
    return files.read_raster_long(spark, path, ("vv", "vh")).groupBy("time").agg(F.count("*").alias("n"), F.round(F.sum("vv"), 4).alias("vv"))


@register(f"WITH {v.HOURLY} SELECT ts, round(tp_mm, 4) AS tp_mm FROM hourly")
def rain_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rainfall through its CSV cache; a second write changes nothing."""
    grid = v.rain_grid(spark, sf)
    hourly = rainfall.rain_hourly(rainfall.hour_spine(grid, F.min("ts"), F.max("ts")), [rainfall.rain_area_mean(grid)])
    path = fresh(spark, "rain")
    files.write_rain_csv(hourly.withColumn("tp_mm", F.round("tp_mm", 4)), path)
    files.write_rain_csv(hourly.limit(0), path)
    return files.read_rain_csv(spark, path)


@register(f"WITH {v.BAND} SELECT row, col, t < 0 AS flooded FROM band")
def write_layer(spark: SparkSession, sf: str) -> DataFrame:
    """A layer that is written once and kept on the second write."""
    path = fresh(spark, "layer")
    layer = v.band(spark, sf).select("row", "col", (F.col("t") < 0).alias("flooded"))
    files.write_layer(layer, path)
    files.write_layer(layer.withColumn("flooded", F.lit(None).cast("boolean")), path)
    return spark.read.parquet(path)


@register("SELECT event_id, ts AS utc, value AS x, CAST(user_id AS DOUBLE) AS vx FROM events")
def read_orbit_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Events as state vectors, written as XML and read again."""
    number = lambda c: F.struct(c.cast("double").alias("_VALUE"), F.lit("m").alias("_unit"))
    e = v.events(spark, sf)
    osv = e.select(
        F.concat(F.lit("UTC="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("UTC"),
        number(F.col("value")).alias("X"), number(F.col("event_id")).alias("Y"), number(F.lit(0)).alias("Z"),
        number(F.col("user_id")).alias("VX"), number(F.lit(0)).alias("VY"), number(F.lit(0)).alias("VZ"),
    )
    path = fresh(spark, "osv")
    osv.write.format("xml").option("rowTag", "OSV").option("rootTag", "List_of_OSVs").save(path)
    return files.read_orbit_xml(spark, path).select(F.col("y").cast("long").alias("event_id"), "utc", "x", "vx")


@register("SELECT line, count(*) AS n FROM (SELECT unnest(['0', '0', '0', (SELECT CAST(count(*) AS VARCHAR) FROM events)]) AS line UNION ALL SELECT CAST(event_id AS VARCHAR) || ' ' || CAST(user_id AS VARCHAR) || ' 0.0 0.0' FROM events) GROUP BY 1")
def write_orbit_table(spark: SparkSession, sf: str) -> DataFrame:
    """The orbit table as text; number formats differ between engines, so whole numbers are kept."""
    e = v.events(spark, sf)
    osv = e.select(F.col("ts").alias("utc"), F.col("event_id").alias("x"), F.col("user_id").alias("y"), *[F.lit(0).alias(c) for c in ("z", "vx", "vy", "vz")])
    path = fresh(spark, "orbit-table")
    files.write_orbit_table(osv, path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    parts = F.split("line", " ")
    return lines.select(F.when(F.size(parts) > 1, F.concat_ws(" ", parts[1], parts[2], parts[7], parts[8])).otherwise(F.col("line")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@register("""SELECT DISTINCT link FROM (SELECT unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS link FROM pages) WHERE suffix(link, 'e') OR suffix(link, 'the,')""")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return files.extract_links(v.table(spark, sf, "pages"), suffixes=("e", "the,"))


#: Colours of the first flood dates; later dates have none.
COLOURS = ("green", "blue", "red", "purple", "brown", "grey", "pink")


@register(f"""WITH {v.BAND}, f AS (SELECT CAST(row // 40 AS INT) AS flood_ts, row, col FROM band WHERE t < -0.35)
  SELECT flood_ts, 'event ' || flood_ts AS flood_event, CASE flood_ts {" ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(COLOURS))} END AS plot_color, count(*) AS n_pixels,
    md5(string_agg(row || ':' || col, ',' ORDER BY row, col)) AS pixels, min(col) * 0.5e0 + 10 AS x0, (max(col) + 1) * 0.5e0 + 10 AS x1, 60 - (max(row) + 1) * 0.25e0 AS y0, 60 - min(row) * 0.25e0 AS y1
  FROM f GROUP BY 1""")
def write_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Flooded regions in map coordinates as GeoJSON, read again and burnt: the pixels in the polygons, members and box per date."""
    flood = v.band(spark, sf).where("t < -0.35").select("row", "col", F.floor(F.col("row") / 40).cast("int").alias("flood_ts"))
    keys = ("flood_ts",)
    shapes = outlines.region_polygons(regions.connected_components(flood, tile=32, keys=keys), 32, keys)
    about = catalogue.date_colour(flood.select("flood_ts"), COLOURS).select(
        "flood_ts", F.concat(F.lit("event "), F.col("flood_ts").cast("string")).alias("flood_event"), F.lit("flooded regions").alias("description"), F.current_timestamp().cast("string").alias("created"), F.col("colour").alias("plot_color")
    )
    path = fresh(spark, "geojson")
    files.write_geojson(files.geojson_lines(outlines.to_map(shapes, (0.5, 0, 10, 0, -0.25, 60)), about), path)
    rings = F.transform(F.flatten("polygons"), lambda ring: F.transform(ring, lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat"))))
    runs = raster.pixel_runs(files.read_geojson(spark, path), rings, 10.25, 59.875, 0.5, -0.25, raster.grid_extent(flood), ("flood_ts", "region"))
    held = runs.select("flood_ts", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    places = F.transform(F.array_sort(F.collect_list(F.struct("row", "col"))), lambda p: F.concat_ws(":", p["row"].cast("string"), p["col"].cast("string")))
    heads = spark.read.text(path).where(F.startswith("value", F.lit('{"type":"FeatureCollection"'))).select("flood_ts", F.from_json(F.concat("value", F.lit("]}")), "flood_event string, plot_color string, bbox array<double>").alias("h"))
    box = [F.col("h.bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return held.groupBy("flood_ts").agg(F.count("*").alias("n_pixels"), F.md5(F.array_join(places, ",")).alias("pixels")).join(heads.select("flood_ts", "h.flood_event", "h.plot_color", *box), "flood_ts")


@register(f"WITH {v.BAND} SELECT row, col FROM band WHERE col + 0.5 > 10 AND col + 0.5 < 60 AND row + 0.5 > 5 AND row + 0.5 < 40")
def aoi_from_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of an area that is made from a box, written as GeoJSON and read again."""
    path = fresh(spark, "aoi")
    area = files.aoi_from_bbox(spark, 10, 5, 60, 40)
    area.select(F.concat(F.lit('{"features":[{"geometry":'), "geojson", F.lit("}]}"))).coalesce(1).write.text(path)
    pixels = v.band(spark, sf).select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    ring = files.aoi_from_vector(spark, path).select("ring")
    return raster.clip_to_ring(pixels.crossJoin(F.broadcast(ring)), F.col("ring")).select("row", "col")  # one row


@register(f"WITH {v.BAND} SELECT row, col, t AS value FROM band")
def read_raster_chips(spark: SparkSession, sf: str) -> DataFrame:
    """A raster written as chips of 25 x 25 values and read as pixels again."""
    size = 25
    band = v.band(spark, sf)
    # a chip has a value, maybe NULL, for each of its places
    c = raster.whole_chips(band, "t", size)
    path = fresh(spark, "chips")
    c.select((F.col("cy") * size).alias("row0"), (F.col("cx") * size).alias("col0"), F.lit(size).alias("w"), "values").write.parquet(path)
    return files.read_raster_chips(spark, path).where("value is not null")
