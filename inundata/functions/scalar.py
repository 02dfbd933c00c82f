"""Column functions on backscatter, angles, names and times (all built-in expressions).

Missing values are NULL, never NaN. ANSI mode stays on, so divisions are guarded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the patch model: channel means and deviations of VV and VH, and the clamp.
MODEL_MEAN, MODEL_STD, MODEL_TOP = (0.0953, 0.0264), (0.0427, 0.0215), 0.15
#: Fixed values of the orbit rule: seconds of one revolution, and the relative orbit offsets.
ORBIT_SECONDS = 12 * 86400.0 / 175.0
ORBIT_OFFSET = {"S1A": 73, "S1B": 27}
#: Fixed formats of product and orbit file names.
PRODUCT_NAME = (
    r"^(S1[AB])_(S[1-6]|IW|EW|WV|EN|N[1-6]|IM)_(SLC|GRD|RAW|OCN)([FHM_])_([012S])([SA])(SH|SV|DH|DV|HH|HV|VV|VH)"
    r"_(\d{8}T\d{6})_(\d{8}T\d{6})_(\d{6})_([0-9A-F]{6})_([0-9A-F]{4})"
)
ORBIT_NAME = r"^(S1[AB])_OPER_AUX_(POE|RES|PRE)ORB_OPOD_(\d{8}T\d{6})_V(\d{8}T\d{6})_(\d{8}T\d{6})"
STAMP = "yyyyMMdd'T'HHmmss"
#: Fixed land-cover codes with their names and colours (red, green, blue, opacity).
LANDCOVER = {
    0: ("No data", (0, 0, 0, 0)),
    10: ("Tree cover", (0, 100, 0, 1)),
    20: ("Shrubland", (255, 187, 34, 1)),
    30: ("Grassland", (255, 255, 76, 1)),
    40: ("Cropland", (240, 150, 255, 1)),
    50: ("Built-up", (250, 0, 0, 1)),
    60: ("Bare/sparse vegetation", (180, 180, 180, 1)),
    70: ("Snow and Ice", (240, 240, 240, 1)),
    80: ("Permanent water bodies", (0, 100, 200, 1)),
    90: ("Herbaceous wetland", (0, 150, 160, 1)),
    95: ("Mangroves", (0, 207, 117, 1)),
    100: ("Moss and lichen", (250, 230, 160, 1)),
}
#: Place (from 1) and length of their fields, which both formats fix.
PRODUCT_PLACES = {
    "mission": (1, 3), "beam": (5, 2), "product_type": (8, 3), "resolution": (11, 1), "level": (13, 1), "class": (14, 1), "polarisation": (15, 2),
    "start": (18, 15), "stop": (34, 15), "absolute_orbit": (50, 6), "datatake": (57, 6), "unique_id": (64, 4),
}
ORBIT_PLACES = {"mission": (1, 3), "kind": (14, 3), "created": (26, 15), "start": (43, 15), "stop": (59, 15)}


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def to_db(power: Column) -> Column:
    """10 log10; NULL for zero and below."""
    return F.when(power > 0, 10.0 * F.log10(power))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def model_normalise(power: Column, channel: int) -> Column:
    """Clamp to [0, top], missing to top, then standardise for channel 0 (VV) or 1 (VH)."""
    clamped = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(MODEL_TOP), power)), F.lit(MODEL_TOP))
    return (clamped - MODEL_MEAN[channel]) / MODEL_STD[channel]


def below(value: Column, threshold: Column | float) -> Column:
    """``value < threshold``, false where either is missing."""
    return F.coalesce(value < threshold, F.lit(False))


def above(value: Column, threshold: Column | float) -> Column:
    return F.coalesce(value > threshold, F.lit(False))


def class_equals(cls: Column, wanted: float) -> Column:
    return F.coalesce(cls == wanted, F.lit(False))


def landcover_label(code: Column) -> Column:
    """struct(name, rgba) of a land-cover code; NULL for unknown codes."""
    table = F.create_map(*[x for k, (name, rgba) in LANDCOVER.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.array(*[F.lit(c) for c in rgba]).alias("rgba")))])
    return F.try_element_at(table, code)


def metres_to_mm(c: Column) -> Column:
    return c * 1000.0


def rate_to_mm_per_hour(c: Column) -> Column:
    return c * 3600.0


def nearest_run(hour: Column) -> Column:
    """Index (from 0) of the run hour among 0, 6, 12, 18 that is nearest, the earlier on ties."""
    gaps = F.transform(F.array(*[F.lit(h) for h in (0, 6, 12, 18)]), lambda r: F.abs(r - hour))
    return F.array_position(gaps, F.array_min(gaps)) - 1


def latest_run(hour: Column) -> Column:
    """Index of the last run hour before ``hour``; -1 when there is none."""
    return F.size(F.filter(F.array(*[F.lit(h) for h in (0, 6, 12, 18)]), lambda r: hour > r)) - 1


def attribute(attributes: Column, name: str) -> Column:
    """Value of the first entry of that name, else NULL."""
    return F.try_element_at(F.filter(attributes, lambda a: a["Name"] == name), F.lit(1))["Value"]


def _placed(name: Column, pattern: str | None, places: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """Fields at fixed places of a name; all NULL when the name doesn't have the pattern, if one is given."""
    fields = {field: F.substring(name, at, length) for field, (at, length) in places.items()}
    return fields if pattern is None else {field: F.when(name.rlike(pattern), c) for field, c in fields.items()}


def product_fields(name: Column, checked: bool = False) -> dict[str, Column]:
    """The fields of a product file name; all NULL when the name is none.

    The pattern is tested once a field; a caller that has filtered on it says ``checked``.
    """
    parts = _placed(name, None if checked else PRODUCT_NAME, PRODUCT_PLACES)
    parts["start"] = F.try_to_timestamp(parts["start"], F.lit(STAMP))
    parts["stop"] = F.try_to_timestamp(parts["stop"], F.lit(STAMP))
    parts["absolute_orbit"] = parts["absolute_orbit"].cast("int")
    parts["relative_orbit"] = relative_orbit(parts["mission"], parts["absolute_orbit"])
    return parts


def relative_orbit(mission: Column, absolute: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, offset in ORBIT_OFFSET.items():
        out = F.when(mission == name, (F.pmod(absolute - offset, F.lit(175)) + 1).cast("int")).otherwise(out)
    return out


def orbit_fields(name: Column, checked: bool = False) -> dict[str, Column]:
    """mission, orbit_type (precise, restituted, predicted), created, start, stop of an orbit file name."""
    parts = _placed(name, None if checked else ORBIT_NAME, ORBIT_PLACES)
    kinds = F.create_map(*[F.lit(x) for pair in (("POE", "precise"), ("RES", "restituted"), ("PRE", "predicted")) for x in pair])
    times = {n: F.try_to_timestamp(parts[n], F.lit(STAMP)) for n in ("created", "start", "stop")}
    return {"mission": parts["mission"], "orbit_type": F.try_element_at(kinds, parts["kind"])} | times


def orbit_path_parts(name: Column) -> dict[str, Column]:
    """sensor, year, month and time by position in a product name."""
    return {"sensor": F.substring(name, 1, 3), "year": F.substring(name, 18, 4), "month": F.substring(name, 22, 2), "time": F.substring(name, 18, 15)}


def utc_stamp(text: Column) -> Column:
    """``UTC=2020-01-01T00:00:00.5`` as a timestamp."""
    return F.try_to_timestamp(F.regexp_replace(text, "^UTC=", ""))


def seconds_of_day(ts: Column) -> Column:
    """Seconds since midnight, microseconds included."""
    return F.pmod(F.unix_micros(ts), F.lit(86_400_000_000)) / 1e6


def outer_ring(footprint: Column) -> Column:
    """The outer ring of GeoJSON coordinates as an array of struct(lon, lat)."""
    return F.transform(F.element_at(footprint, 1), lambda xy: F.struct(xy[0].alias("lon"), xy[1].alias("lat")))


def bbox_ring(lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> Column:
    """A closed ring of five points around a bounding box."""
    corners = [(lon_min, lat_min), (lon_max, lat_min), (lon_max, lat_max), (lon_min, lat_max), (lon_min, lat_min)]
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in corners])


def ring_bounds(ring: Column) -> Column:
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("lon_min"), F.array_min(lat).alias("lat_min"), F.array_max(lon).alias("lon_max"), F.array_max(lat).alias("lat_max"))


def ring_sides(ring: Column) -> Column:
    """Consecutive corner pairs of a ring, closed if it is open."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, F.pmod(i + 1, n)).alias("b")))


def ring_centroid(ring: Column) -> Column:
    """struct(lon, lat); NULL for a ring without area."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(t: Column, e: Column) -> Column:
        c = e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
        return F.struct((t["s"] + c).alias("s"), (t["x"] + (e["a"]["lon"] + e["b"]["lon"]) * c).alias("x"), (t["y"] + (e["a"]["lat"] + e["b"]["lat"]) * c).alias("y"))

    return F.aggregate(
        ring_sides(ring), zero, add, lambda t: F.when(t["s"] != 0, F.struct((t["x"] / (3 * t["s"])).alias("lon"), (t["y"] / (3 * t["s"])).alias("lat")))
    )


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd crossing test."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dy = F.when(b["lat"] != a["lat"], b["lat"] - a["lat"])
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / dy + a["lon"]), F.lit(False))

    return F.size(F.filter(ring_sides(ring), crosses)) % 2 == 1


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: a corner of one inside the other, or sides that touch."""
    turn = lambda e, p: (e["b"]["lon"] - e["a"]["lon"]) * (p["lat"] - e["a"]["lat"]) - (e["b"]["lat"] - e["a"]["lat"]) * (p["lon"] - e["a"]["lon"])
    apart = lambda e, f, c: F.greatest(e["a"][c], e["b"][c]) < F.least(f["a"][c], f["b"][c])

    def touch(e: Column, f: Column) -> Column:
        boxes = ~(apart(e, f, "lon") | apart(f, e, "lon") | apart(e, f, "lat") | apart(f, e, "lat"))
        return boxes & (F.signum(turn(e, f["a"])) * F.signum(turn(e, f["b"])) <= 0) & (F.signum(turn(f, e["a"])) * F.signum(turn(f, e["b"])) <= 0)

    def corner(of: Column, ring: Column) -> Column:
        return F.exists(of, lambda p: in_ring(p["lon"], p["lat"], ring))

    return corner(a, b) | corner(b, a) | F.exists(ring_sides(a), lambda e: F.exists(ring_sides(b), lambda f: touch(e, f)))


def boxes_overlap(a: Column, b: Column) -> Column:
    return (a["lon_min"] <= b["lon_max"]) & (b["lon_min"] <= a["lon_max"]) & (a["lat_min"] <= b["lat_max"]) & (b["lat_min"] <= a["lat_max"])
