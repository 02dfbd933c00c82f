"""Whole regions as polygons, stitched across tiles.

A tile traces the borders of its own cells. What lies inside a tile is a ring at once; the rest is
open chains, and single sides along the tile's frame. Sides that two tiles share within one region
cancel in a join. Each chain or side is then followed by the one that starts where it ends, and
pointers along these followers that grow fourfold a round find, in as many rounds as the logarithm
of the longest ring has, the least piece of every ring and each piece's way to it. The cancelled sides also say which
parts of tiles belong together, so a hole finds its outer ring by a number and not by a search. What
travels is borders only; a row holds a region's outline and never its cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inundata.functions.kernels import traced
from inundata.operators.regions import components_of_edges
from inundata.operators.tiles import dealt, in_steps, whole_tiles
from inundata.sources.folders import cut, stored

POINT = "struct<x:double,y:double>"
_BASE = 1 << 31


def _pieces(regions: DataFrame, tile: int, keys: tuple[str, ...], cells: int = 100_000) -> DataFrame:
    """keys, region, part, kind (ring, chain, side), x0, y0, x1, y1, d0, d1, points of every tile's borders.

    Tiles are traced many in a call, as many as ``cells`` allows.
    """
    kinds = dict(regions.dtypes)
    key_schema = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    placed = regions.withColumns({"ty": F.floor(F.col("row") / tile), "tx": F.floor(F.col("col") / tile)})
    marks, step = [*keys, "ty", "tx"], max(1, cells // tile**2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_tiles(batches, marks):
            for a, b in in_steps(at, step):
                yield from borders(table.slice(a, b - a), at[a:b] - at[a]).combine_chunks().to_batches()

    def borders(table: pa.Table, at: np.ndarray) -> pa.Table:
        # tiles one below the other, with a blank line between
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        top, left = (table[p].to_numpy()[heads] * tile for p in ("ty", "tx"))
        names, number = np.unique(table["region"].to_numpy(), return_inverse=True)
        grid = np.zeros((len(heads) * (tile + 1), tile), dtype=np.int64)
        grid[at * (tile + 1) + table["row"].to_numpy() - top[at], table["col"].to_numpy() - left[at]] = number + 1
        part, kind, corners, d0, d1 = zip(*traced(grid, tile), strict=True)
        r, c = np.divmod(np.array(part) - 1, tile)
        of = r // (tile + 1)
        down, right = top[of] - of * (tile + 1), left[of]
        # a chain's or a side's last corner is the first one of what follows
        sizes = np.array([len(x) for x in corners]) - [k != "ring" for k in kind]
        piece = np.repeat(np.arange(len(part)), sizes)
        x, y = np.array([p for ring, n in zip(corners, sizes.tolist(), strict=True) for p in ring[:n]], dtype=np.int64).T
        points = pa.StructArray.from_arrays([pa.array((x + right[piece]).astype(float)), pa.array((y + down[piece]).astype(float))], ["x", "y"])
        (x0, y0), (x1, y1) = (np.array([ring[k] for ring in corners], dtype=np.int64).T for k in (0, -1))
        out = table.select(list(keys)).take(heads[of]) if keys else None
        made = {
            "region": names[grid[r, c] - 1], "part": (r + down) * _BASE + c + right, "kind": pa.array(kind, pa.string()),
            "x0": x0 + right, "y0": y0 + down, "x1": x1 + right, "y1": y1 + down, "d0": pa.array(d0, pa.int32()), "d1": pa.array(d1, pa.int32()),
            "points": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), points),
        }
        return pa.table({k: out[k] for k in keys} | made)

    schema = f"{key_schema}region long, part long, kind string, x0 long, y0 long, x1 long, y1 long, d0 int, d1 int, points array<{POINT}>"
    return dealt(placed, keys).sortWithinPartitions(*marks).mapInArrow(run, schema)


def _part_name(part: str, keys: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *keys, F.lpad(F.col(part).cast("string"), 20, "0"))


def _followed(links: DataFrame, on: list[str]) -> DataFrame:
    """id, next: each piece and the one after it.

    At most two pieces of a region start in one corner. Where two do, cells meet at that corner
    only, and a ring turns right there, which keeps it with its own cell.
    """
    starts = links.groupBy(*on, F.col("x0").alias("x1"), F.col("y0").alias("y1")).agg(F.collect_list(F.struct("d0", "id")).alias("out"))
    right = F.filter("out", lambda o: o["d0"] == F.pmod(F.col("d1") + 1, F.lit(4)))
    after = F.when(F.size("out") > 1, F.get(right, 0)).otherwise(F.get("out", 0))
    return links.join(starts, [*on, "x1", "y1"]).select("id", after["id"].alias("next"))


def ring_order(follow: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, ring, steps of pieces on rings (id, next): the least id of the ring, and the steps on to it.

    Each round makes the stretch that a piece has looked over four times as long. When its last
    quarter lowers no least id anywhere, the stretches reach around every ring.
    """
    state = cut(follow.select("id", F.col("next").alias("jump"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("steps")))
    span = 1

    def doubled(now: DataFrame) -> DataFrame:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("ring").alias("ring2"), F.col("steps").alias("steps2"))
        nearer = F.col("ring2") < F.col("ring")
        return now.join(ahead, "jump").select(
            "id",
            F.col("jump2").alias("jump"),
            F.least("ring", "ring2").alias("ring"),
            F.when(nearer, F.col("steps2") + now_span).otherwise(F.col("steps")).alias("steps"),
            nearer.alias("moved"),
        )

    for _ in range(max_rounds):
        # three joins with stretches of one length make a stretch four times as long, written once
        now = state
        for k in range(1, 4):
            now_span = k * span
            now = doubled(now).drop("moved") if k < 3 else doubled(now)
        state, span = cut(now), span * 4
        if state.where("moved").isEmpty():
            return state.select("id", "ring", "steps")
    raise RuntimeError("rings did not settle")


def _bends(ring: Column) -> Column:
    """An open ring of corners without those on a straight side."""
    n = F.size(ring)

    def bend(p: Column, i: Column) -> Column:
        a, b = F.get(ring, F.pmod(i - 1, n)), F.get(ring, F.pmod(i + 1, n))
        return ~((a["x"] == p["x"]) & (p["x"] == b["x"])) & ~((a["y"] == p["y"]) & (p["y"] == b["y"]))

    return F.filter(ring, bend)


def _from_top(ring: Column) -> Column:
    """An open ring turned to begin with its first corner by y and then x, and closed."""
    places = F.transform(ring, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))
    at = F.array_position(places, F.array_min(places)).cast("int")
    turned = F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, F.lit(1), at - 1))
    return F.concat(turned, F.slice(turned, 1, 1))


def region_polygons(regions: DataFrame, tile: int = 512, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, region, polygons: one row per region, each polygon an outer ring and then its holes.

    ``regions``: keys, row, col, region of the true pixels. Rings are in pixel corners, closed, and
    begin at their topmost and then leftmost corner; outer ones have a positive shoelace sum, holes
    a negative one. Cells that meet at corners only are several polygons of their region. The
    result doesn't depend on the tile size. Keys are not null. No pixels give no rows.
    """
    on = [*keys, "region"]
    pieces = stored(_pieces(regions, tile, keys))
    side = [*on, (F.col("x0") + F.col("x1")).alias("mx"), (F.col("y0") + F.col("y1")).alias("my")]
    own = ["part", "kind", "x0", "y0", "x1", "y1", "d0", "d1", "points"]
    sides = stored(
        pieces.where("kind = 'side'")
        .groupBy(*side)
        .agg(F.count("*").alias("n"), F.min("part").alias("a"), F.max("part").alias("b"), F.first(F.struct(*own)).alias("s"))
    )
    joined = components_of_edges(sides.where("n > 1 and a <> b").select(_part_name("a", keys).alias("a"), _part_name("b", keys).alias("b")))
    links = stored(pieces.where("kind = 'chain'").select(*on, *own).unionByName(sides.where("n = 1").select(*on, "s.*")).withColumn("id", F.monotonically_increasing_id()))
    order = ring_order(_followed(links, on))
    # the piece that names the ring comes first, then those with the longest way to it
    place = F.when(F.col("steps") == 0, F.lit(-(2**62))).otherwise(-F.col("steps"))
    stitched = (
        links.join(order, "id")
        .groupBy(*on, "ring")
        .agg(F.min("part").alias("part"), F.array_sort(F.collect_list(F.struct(place.alias("place"), "points"))).alias("run"))
        .select(*on, "part", F.flatten("run.points").alias("ring"))
        .select(*on, "part", _bends(F.col("ring")).alias("ring"))
    )
    rings = pieces.where("kind = 'ring'").select(*on, "part", F.col("points").alias("ring")).unionByName(stitched)
    placed = rings.withColumn("node", _part_name("part", keys)).join(joined, "node", "left")
    closed = placed.select(*on, F.coalesce("component", "node").alias("part"), _from_top(F.col("ring")).alias("ring")).withColumn("hole", _signed(F.col("ring")) < 0)
    first = F.struct(F.col("ring")[0]["y"].alias("y"), F.col("ring")[0]["x"].alias("x"))
    polygons = closed.groupBy(*on, "part").agg(
        F.min(F.when(~F.col("hole"), first)).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("hole", first.alias("first"), "ring"))), lambda x: x["ring"]).alias("polygon")
    )
    return polygons.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "polygon"))), lambda x: x["polygon"]).alias("polygons"))


def _signed(ring: Column) -> Column:
    edge = F.transform(ring, lambda p, i: F.when(i > 0, F.get(ring, i - 1)["x"] * p["y"] - p["x"] * F.get(ring, i - 1)["y"]).otherwise(0.0))
    return F.aggregate(edge, F.lit(0.0), lambda s, v: s + v) / 2.0


def to_map(shapes: DataFrame, affine: Sequence[float]) -> DataFrame:
    """``polygons`` in map coordinates: x' = a x + b y + c, y' = d x + e y + f for (a, b, c, d, e, f).

    Rings are turned round where the transform mirrors, as it does when rows run south: outer rings
    stay counter-clockwise in the map, holes clockwise.
    """
    a, b, c, d, e, f = (float(v) for v in affine)

    def moved(ring: Column) -> Column:
        out = F.transform(ring, lambda p: F.struct((a * p["x"] + b * p["y"] + c).alias("x"), (d * p["x"] + e * p["y"] + f).alias("y")))
        return F.reverse(out) if a * e - b * d < 0 else out

    return shapes.withColumn("polygons", F.transform("polygons", lambda shape: F.transform(shape, moved)))


def polygon_area(shapes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, region, area in squared units, holes: signed shoelace sums, so holes count against it."""
    rings = F.flatten("polygons")
    total = F.aggregate(F.transform(rings, _signed), F.lit(0.0), lambda s, v: s + v)
    return shapes.groupBy(*keys, "region").agg(F.sum(total).alias("area"), F.sum(F.size(rings) - F.size("polygons")).cast("long").alias("holes"))
