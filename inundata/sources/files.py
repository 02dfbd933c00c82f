"""Readers and writers: catalogues, rasters, rainfall, orbit vectors, links, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.functions.scalar import bbox_ring, outer_ring, ring_bounds, zero_to_null
from inundata.operators.raster import chip_pixels

#: Schema of one catalogue answer.
CATALOGUE = (
    "value array<struct<Id:string, Name:string, PublicationDate:timestamp, "
    "Attributes:array<struct<Name:string, Value:string>>, GeoFootprint:struct<coordinates:array<array<array<double>>>>>>"
)
BANDS = ("sigma0_vv", "sigma0_vh", "lat", "lon", "elevation", "lia")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per product of JSON answers."""
    return spark.read.schema(CATALOGUE).json(path).select(F.explode("value").alias("p")).select("p.*")


def read_raster_long(spark: SparkSession, path: str, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Per-pixel rows of scenes stored long; 0 means missing in every band."""
    raw = spark.read.parquet(path)
    return raw.select(*[zero_to_null(F.col(c)).alias(c) if c in bands else F.col(c) for c in raw.columns])


def read_raster_chips(spark: SparkSession, path: str) -> DataFrame:
    """row, col, value of scenes stored as chips (row0, col0, w, values)."""
    return chip_pixels(spark.read.parquet(path))


def write_stack(scenes: list[DataFrame], path: str) -> None:
    """Scenes joined along time, a folder per time."""
    stack = scenes[0]
    for more in scenes[1:]:
        stack = stack.unionByName(more)
    # a time of many pixels is several files, by rows of the grid
    width = int(stack.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stack.repartitionByRange(width, "time", "row").write.mode("overwrite").partitionBy("time").parquet(path)


def write_layer(layer: DataFrame, path: str, by: str | None = None) -> None:
    """A derived layer, unless it is there already."""
    writer = layer.write.mode("ignore")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_rain_csv(rain: DataFrame, path: str) -> None:
    rain.write.mode("ignore").option("header", True).csv(path)


def read_rain_csv(spark: SparkSession, path: str, schema: str = "ts timestamp, tp_mm double") -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def aoi_from_bbox(spark: SparkSession, lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> DataFrame:
    """One row: ring (closed, five points) and its GeoJSON text."""
    ring = bbox_ring(lon_min, lat_min, lon_max, lat_max)
    coordinates = F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    return spark.range(1).select(ring.alias("ring"), F.to_json(geometry).alias("geojson"))


def aoi_from_vector(spark: SparkSession, path: str) -> DataFrame:
    """One row: ring and bounds of a GeoJSON file; an error unless it has exactly one geometry."""
    schema = "features array<struct<geometry:struct<type:string, coordinates:array<array<array<double>>>>>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features.geometry.coordinates").alias("c"))
    if (n := found.limit(2).count()) != 1:
        raise ValueError(f"one geometry is needed, not {n}{' or more' if n else ''}")
    return found.select(outer_ring(F.col("c")).alias("ring")).withColumn("bounds", ring_bounds(F.col("ring")))


def read_orbit_xml(spark: SparkSession, path: str) -> DataFrame:
    """utc, x, y, z, vx, vy, vz of an orbit file's state vectors."""
    number = "struct<_VALUE:double, _unit:string>"
    schema = "UTC string, " + ", ".join(f"{c} {number}" for c in ("X", "Y", "Z", "VX", "VY", "VZ"))
    raw = spark.read.format("xml").option("rowTag", "OSV").schema(schema).load(path)
    utc = F.try_to_timestamp(F.regexp_replace("UTC", "^UTC=", ""))
    return raw.select(utc.alias("utc"), *[F.col(f"{c}._VALUE").alias(c.lower()) for c in ("X", "Y", "Z", "VX", "VY", "VZ")])


def extract_links(pages: DataFrame, html: str = "html", suffixes: tuple[str, ...] = (".EOF", ".EOF.zip")) -> DataFrame:
    """link: distinct href values of <a> tags that end in one of the suffixes."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.endswith(F.col("link"), F.lit(s))
    return pages.select(F.explode(found).alias("link")).where(ends).distinct()


def orbit_table_lines(osv: DataFrame) -> DataFrame:
    """place, line: 0, 0, 0 and the count, then one line per state vector in time order.

    Seconds are those of the day. The line number comes from the sort key, not from one task.
    """
    seconds = (F.pmod(F.unix_micros("utc"), F.lit(86_400_000_000)) / 1e6).alias("s")
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("s", "x", "y", "z", "vx", "vy", "vz")], F.lit("0.0"), F.lit("0.0"))
    body = osv.select("utc", seconds, "x", "y", "z", "vx", "vy", "vz").select(F.unix_micros("utc").alias("place"), text.alias("line"))
    count = osv.agg(F.count("*").alias("n"))
    head = count.select(F.explode(F.array(*[F.struct(F.lit(i - 4).cast("long").alias("place"), (F.lit("0") if i < 3 else F.col("n").cast("string")).alias("line")) for i in range(4)])).alias("h")).select("h.*")
    return head.unionByName(body)


def write_orbit_table(osv: DataFrame, path: str) -> None:
    orbit_table_lines(osv).orderBy("place").select("line").write.mode("overwrite").text(path)


def geojson_lines(shapes: DataFrame, about: DataFrame) -> DataFrame:
    """flood_ts, place, line: the lines of one FeatureCollection per flood date.

    ``shapes``: flood_ts, region, polygons (rings of struct x, y, as ``outlines.to_map`` gives
    them). ``about``: one row per flood date; its other columns become members of the collection,
    NULLs left out. A ``bbox`` is added from the shapes where ``about`` has none. A region is one
    feature, a Polygon or a MultiPolygon, on a line of its own; nothing gathers a whole date. A
    date without regions is an empty collection.
    """
    coordinates = F.transform("polygons", lambda shape: F.transform(shape, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))

    def feature(kind: str, of: Column) -> Column:
        geometry = F.struct(F.lit(kind).alias("type"), of.alias("coordinates"))
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("region").alias("region")).alias("properties"), geometry.alias("geometry")))

    points = F.flatten(F.flatten("polygons"))
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    boxed = shapes.select(
        "flood_ts", F.col("region").alias("place"), F.when(F.size("polygons") == 1, feature("Polygon", coordinates[0])).otherwise(feature("MultiPolygon", coordinates)).alias("json"),
        F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"),
    )
    dates = boxed.groupBy("flood_ts").agg(F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("box"), F.min("place").alias("first"))
    members = [c for c in about.columns if c != "flood_ts"]
    known = about.join(dates, "flood_ts", "left")
    envelope = F.struct(F.lit("FeatureCollection").alias("type"), *members, *([] if "bbox" in members else [F.col("box").alias("bbox")]))
    head = known.select("flood_ts", F.lit(-1).cast("long").alias("place"), F.concat(F.regexp_replace(F.to_json(envelope), r"\}$", ""), F.lit(',"features":[')).alias("line"))
    tail = known.select("flood_ts", F.lit(2**63 - 1).alias("place"), F.lit("]}").alias("line"))
    comma = F.when(F.col("place") == F.col("first"), "").otherwise(",")
    body = boxed.join(known.select("flood_ts", "first"), "flood_ts").select("flood_ts", "place", F.concat(comma, "json").alias("line"))
    return head.unionByName(body).unionByName(tail)


def write_geojson(lines: DataFrame, path: str) -> None:
    """A folder per flood date, whose part files in the order of their names are one GeoJSON text."""
    lines.orderBy("flood_ts", "place").select("flood_ts", "line").write.mode("overwrite").partitionBy("flood_ts").text(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """flood_ts, region, polygons (rings of struct x, y) of what ``write_geojson`` has written."""
    lines = spark.read.text(path).select("flood_ts", F.regexp_replace("value", "^,", "").alias("line")).where(F.startswith("line", F.lit('{"type":"Feature",')))
    parsed = lambda schema: F.from_json("line", f"properties struct<region:bigint>, geometry struct<type:string, coordinates:{schema}>")
    rings = "array<array<array<double>>>"
    one, many = parsed(rings), parsed(f"array<{rings}>")
    shapes = F.when(one["geometry"]["type"] == "Polygon", F.array(one["geometry"]["coordinates"])).otherwise(many["geometry"]["coordinates"])
    points = F.transform(shapes, lambda shape: F.transform(shape, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    return lines.select("flood_ts", one["properties"]["region"].alias("region"), points.alias("polygons"))
