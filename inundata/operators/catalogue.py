"""Product catalogues: attributes, filters, one product per start, thinning, passes, days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inundata.functions.scalar import PRODUCT_NAME, attribute, boxes_overlap, outer_ring, product_fields, ring_bounds, rings_meet
from inundata.operators.scans import chain
from inundata.sources.folders import cut

#: Fixed names of the attributes that become columns.
ATTRIBUTES = ("beginningDateTime", "endingDateTime", "orbitDirection", "relativeOrbitNumber", "productType", "swathIdentifier")


def catalogue_attributes(products: DataFrame, names: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    return products.select("*", *[attribute(F.col("Attributes"), n).alias(n) for n in names])


def catalogue_query(
    products: DataFrame, bounds: Column, start: Column, end: Column, product_type: str = "GRD", most: int = 1000, area: Column | None = None, collection: str | None = None
) -> DataFrame:
    """Products of one type whose footprint box meets ``bounds`` and that begin strictly between two times.

    With ``area`` (a ring) the footprint itself must meet that; ``collection`` is compared with a
    column of that name.

    The first ``most`` by begin and Id: the catalogue's own limit, which is part of the query.
    """
    begin = F.try_to_timestamp("beginningDateTime")
    ring = outer_ring(F.col("GeoFootprint.coordinates"))
    met = products.withColumn("begin", begin).where(
        (F.col("productType") == product_type) & (F.col("begin") > start) & (F.col("begin") < end) & boxes_overlap(ring_bounds(ring), bounds)
    )
    if area is not None:
        met = met.where(rings_meet(ring, area))
    if collection is not None:
        met = met.where(F.col("collection") == collection)
    return met.orderBy("begin", "Id").limit(most)


def latest_product(products: DataFrame, begin: str = "begin", published: str = "published", tie: str = "id", keys: tuple[str, ...] = ()) -> DataFrame:
    """One product per begin time: the newest publication, the least id on ties."""
    best = F.max_by(F.struct("*"), F.struct(F.col(published), -F.col(tie) if dict(products.dtypes)[tie] in ("bigint", "int") else F.hex(tie)))
    return products.groupBy(*keys, F.col(begin).alias("_begin")).agg(best.alias("p")).select("p.*")


def thin_datetimes(times: DataFrame, ts: str = "ts", keys: tuple[str, ...] = (), seconds: float = 60.0, ranges: int | None = None) -> DataFrame:
    """keys, ts: the first time, then each time at least ``seconds`` after the last one kept.

    Times are sorted into ranges, so neither a key nor an unbroken run of near times has to fit a
    task; each range says what it makes of the time kept before it (``scans.chain``).
    """
    known = times.where(F.col(ts).isNotNull()).select(*keys, F.unix_micros(ts).alias("_u")).distinct()
    return chain(known, keys, "_u", int(seconds * 1_000_000), ranges).select(*keys, F.timestamp_micros("_u").alias(ts))


def same_pass_products(products: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ("orbitDirection", "relativeOrbitNumber")) -> DataFrame:
    """Products of the same pass as the chosen ones."""
    return products.join(chosen.select(*keys).distinct(), list(keys), "left_semi")


def list_products(names: DataFrame, name: str = "name") -> DataFrame:
    """Names that parse, with their fields; others are dropped silently."""
    parsed = names.where(F.col(name).rlike(PRODUCT_NAME))
    return parsed.select(F.col(name), *[c.alias(k) for k, c in product_fields(F.col(name), checked=True).items()]).where("start is not null")


def scene_day_tiles(scenes: DataFrame, flood: DataFrame, ts: str = "ts", most: int = 2) -> DataFrame:
    """day, n_tiles, image_ts (mean of the tiles' times), supported (``most`` tiles at most).

    A scene within 24 hours after a flood date (both ends included) counts to that date.
    """
    day_after = F.col("flood_ts") + F.expr("INTERVAL 24 HOURS")
    spans = flood.select("flood_ts", F.explode(F.sequence(F.to_date("flood_ts"), F.to_date(day_after), F.expr("INTERVAL 1 DAY"))).alias("d"))
    within = (F.to_date("t") == F.col("d")) & F.col("t").between(F.col("flood_ts"), day_after)
    days = scenes.select(F.col(ts).alias("t")).join(spans, within, "left")
    day = F.coalesce(F.col("flood_ts"), F.date_trunc("day", "t")).alias("day")
    return days.groupBy(day).agg(F.count("*").alias("n_tiles"), F.timestamp_micros(F.round(F.avg(F.unix_micros("t"))).cast("long")).alias("image_ts")).withColumn(
        "supported", F.col("n_tiles") <= most
    )


def pre_flood_dates(scenes: DataFrame, end: Column, ts: str = "ts") -> DataFrame:
    return scenes.where(F.col(ts) < end).select(F.to_date(ts).alias("day")).distinct()


def clearest_per_tile(images: DataFrame, tile: str = "tile", cloud: str = "cloud", name: str = "name", since: Column | None = None, ts: str = "ts") -> DataFrame:
    """tile, name, cloud of the image with the least cloud cover, the first name on ties."""
    rows = images if since is None else images.where(F.col(ts) >= since - F.expr("INTERVAL 90 DAYS"))
    return rows.groupBy(tile).agg(F.min(F.struct(cloud, name)).alias("b")).select(tile, F.col(f"b.{name}").alias(name), F.col(f"b.{cloud}").alias(cloud))


#: Bits of a word of a bitmap.
_BITS = 62


def tile_cover_set(cover: DataFrame, cells: int) -> DataFrame:
    """One row, ``tiles``: a tile that covers every cell, else the first set of tiles that does.

    ``cover``: tile, cells (array of covered cell numbers, 0 to ``cells`` - 1; others don't count).
    The set is the smallest, and of those the first by the order of their tiles; empty only when
    all together leave a cell uncovered.

    Cells are bits, the rarest first. A set grows by the tiles that cover its first missing cell,
    found by an equi-join; of sets of one size with the same cells only the first goes on, as each
    completes the other. Tiles whose cells an earlier tile has too are never needed. So the first
    size at which a set is full is the answer's, whatever that is.
    """
    pairs = cut(cover.where("tile is not null").select("tile", F.explode("cells").alias("cell")).where(F.col("cell").between(0, cells - 1)).distinct())
    counts = pairs.groupBy("cell").agg(F.count("*").alias("n"))
    # one row per cell of one area
    bits = cut(counts.select("cell", (F.row_number().over(Window.orderBy("n", "cell")) - 1).alias("bit")))
    words = -(-cells // _BITS)
    full = [(1 << min(_BITS, cells - k * _BITS)) - 1 for k in range(words)]
    word = lambda k: F.sum(F.when(F.floor(F.col("bit") / _BITS) == k, F.expr(f"shiftleft(1L, cast(bit - {k * _BITS} as int))")).otherwise(F.lit(0).cast("long")))
    tiles = cut(pairs.join(bits, "cell").groupBy("tile").agg(F.array(*[word(k) for k in range(words)]).alias("has")))
    inside = F.forall(F.arrays_zip(F.col("x.has").alias("a"), F.col("y.has").alias("b")), lambda w: w["a"].bitwiseAND(F.bitwise_not(w["b"])) == 0)
    # a tile is compared with the earlier ones that share its rarest cell
    first_bit = pairs.join(bits, "cell").groupBy("tile").agg(F.min_by("cell", "bit").alias("cell"))
    rivals = first_bit.join(pairs.withColumnRenamed("tile", "other"), "cell").where("other < tile").select("tile", "other")
    beaten = rivals.join(tiles.alias("x"), "tile").join(tiles.select(F.col("tile").alias("other"), F.col("has")).alias("y"), "other").where(inside).select("tile")
    useful = cut(tiles.join(beaten, "tile", "left_anti"))
    by_bit = cut(useful.join(pairs, "tile").join(bits, "cell").select("bit", "tile", "has"))

    at = F.array_position(F.transform(F.arrays_zip(F.col("has").alias("h"), F.array(*[F.lit(x) for x in full]).alias("f")), lambda w: w["h"] == w["f"]), F.lit(False)).cast("int") - 1
    own = F.get("has", at)
    missing = at * _BITS + F.bit_count(F.bitwise_not(own).bitwiseAND(own + 1) - 1)  # the lowest bit that is not set
    sets = tiles.limit(0).select(F.array("tile").alias("tiles"), "has").unionByName(
        cover.sparkSession.range(1).select(F.array().cast(f"array<{dict(cover.dtypes)['tile']}>").alias("tiles"), F.array(*[F.lit(0).cast("long")] * words).alias("has"))
    )
    done = F.col("has") == F.array(*[F.lit(x).cast("long") for x in full])
    coverable = counts.count() >= cells
    while coverable and sets.where(done).isEmpty():
        grown = sets.withColumn("bit", missing).join(by_bit.withColumnRenamed("has", "more"), "bit").select(
            F.array_sort(F.concat("tiles", F.array("tile"))).alias("tiles"), F.zip_with("has", "more", lambda a, b: a.bitwiseOR(b)).alias("has")
        )
        sets = cut(grown.groupBy("has").agg(F.min("tiles").alias("tiles")).select("tiles", "has"))
    return sets.where(done).orderBy("tiles").limit(1).select("tiles")


def date_colour(dates: DataFrame, colours: tuple[str, ...], ts: str = "flood_ts") -> DataFrame:
    """flood_ts, colour by place in the ordered list of dates; NULL beyond the last colour."""
    place = F.row_number().over(Window.orderBy(ts))
    return dates.select(ts).distinct().withColumn("colour", F.try_element_at(F.array(*[F.lit(c) for c in colours]), place))
