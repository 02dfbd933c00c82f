"""Rasters as chips, and the exchange of their edges.

A chip is one row: its place and, for each band, the packed values of a square of pixels. Chips are
written in buckets of their place. For work that looks beyond a chip's border, only strips as wide
as the halo go to the chips around; the bodies stay where they are. So what is shuffled grows with
the perimeters of chips and not with the pixels times the chips that need them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.operators.tiles import in_steps, whole_tiles
from inundata.sources.buckets import bucketed

#: Band that says which pixels there are.
HERE = "here"


@dataclass(frozen=True)
class Chips:
    """``frame``: keys, cy, cx, and a binary column per band; flags are bytes, other bands doubles."""

    frame: DataFrame
    tile: int
    bands: tuple[str, ...]
    flags: tuple[str, ...]
    keys: tuple[str, ...]

    @property
    def place(self) -> list[str]:
        return [*self.keys, "cy", "cx"]

    def kind(self, band: str) -> str:
        return "u1" if band in self.flags else "<f8"

    def schema(self, columns: list[str]) -> str:
        kinds = dict(self.frame.dtypes)
        return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def chip_columns(tile: int):
    return {c: F.floor(F.col(p) / tile).cast("int") for c, p in (("cy", "row"), ("cx", "col"))}


def to_chips(pixels: DataFrame, tile: int, bands: tuple[str, ...] = (), flags: tuple[str, ...] = (), keys: tuple[str, ...] = (), cells: int = 1_000_000) -> Chips:
    """Pixels (keys, row, col, bands) as chips; missing values are NaN, missing flags false. One shuffle.

    Chips are packed many at once, as many as ``cells`` allows.
    """
    kinds = dict(pixels.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "cy int, cx int, " + ", ".join(f"`{b}` binary" for b in (*bands, *flags, HERE))
    flat = pixels.select(
        *keys, "row", "col", *[F.col(b).cast("double").alias(b) for b in bands], *[F.coalesce(F.col(b), F.lit(False)).cast("tinyint").alias(b) for b in flags]
    ).withColumns(chip_columns(tile))

    place, step = [*keys, "cy", "cx"], max(1, cells // tile**2)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_tiles(batches, place):
            r, c = (table[p].to_numpy() - table[k].to_numpy().astype(np.int64) * tile for p, k in (("row", "cy"), ("col", "cx")))
            for a, b in in_steps(at, step):
                of = at[a:b] - at[a]
                out = table.select(place).take(np.flatnonzero(np.diff(of, prepend=-1)) + a)
                for band in (*bands, *flags, HERE):
                    grids = np.full((len(out), tile, tile), np.nan) if band in bands else np.zeros((len(out), tile, tile), dtype="u1")
                    grids[of, r[a:b], c[a:b]] = 1 if band == HERE else table[band].to_numpy()[a:b]
                    out = out.append_column(band, packed(grids))
                yield from out.combine_chunks().to_batches()

    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = flat.repartition(n, *place).sortWithinPartitions(*place).mapInArrow(pack, schema)
    return Chips(bucketed(made, tuple(place), "chips", n, dealt=True), tile, bands, (*flags, HERE), keys)


def packed(grids: np.ndarray) -> pa.Array:
    """The bytes of each grid of a stack."""
    return pa.array([g.tobytes() for g in grids], pa.binary())


def _overlaps(tile: int, halo: int) -> list[tuple[int, int, slice, slice]]:
    """dy, dx, rows, cols: the part of a chip that the chip dy, dx further needs for its halo."""

    def one(d: int) -> slice:
        # the other chip covers [d tile - halo, (d + 1) tile + halo) in this chip's own count
        return slice(max(0, d * tile - halo), min(tile, (d + 1) * tile + halo))

    reach = math.ceil(halo / tile)
    return [(dy, dx, one(dy), one(dx)) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dy or dx]


def strips(chips: Chips, halo: int) -> DataFrame:
    """keys, cy, cx of the chip that needs it, oy, ox (its place from there), bands: the strips of every chip."""
    tile, names, keys = chips.tile, [*chips.bands, *chips.flags], list(chips.keys)
    parts, kinds = _overlaps(tile, halo), {b: chips.kind(b) for b in names}  # the tasks get no frame

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            grids = {b: [np.frombuffer(x, dtype=kinds[b]).reshape(tile, tile) for x in pdf[b]] for b in names}
            for dy, dx, rows, cols in parts:
                sent = pdf[keys].assign(cy=pdf["cy"] + dy, cx=pdf["cx"] + dx, oy=-dy, ox=-dx)
                for b in names:
                    sent[b] = [g[rows, cols].tobytes() for g in grids[b]]
                out.append(sent)
            if out:
                yield pd.concat(out)

    schema = (chips.schema(list(chips.keys)) + ", " if chips.keys else "") + "cy int, cx int, oy int, ox int, " + ", ".join(f"`{b}` binary" for b in names)
    return chips.frame.select(*chips.place, *names).mapInPandas(send, schema)


Work = Callable[[dict, int, int, dict[str, np.ndarray]], pd.DataFrame]


def with_halo(chips: Chips, halo: int, work: Work, schema: str, bodies: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """What ``work`` returns for each chip.

    ``work`` takes the chip's row of other columns (keys, cy, cx and whatever else ``bodies`` has),
    the row and column of the first cell of its grids, and the grids of all bands with the halo
    around; ``schema`` is that of its result. Cells beyond the raster are NaN or 0. ``bodies``
    (chips' rows, maybe with more columns) and ``edges`` (strips) are all chips' unless given.
    """
    tile, names, side = chips.tile, [*chips.bands, *chips.flags], chips.tile + 2 * halo
    parts, kinds = {(-dy, -dx): (rows, cols) for dy, dx, rows, cols in _overlaps(tile, halo)}, {b: chips.kind(b) for b in names}

    def run(body: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(body):
            return pd.DataFrame()
        own = {k: v for k, v in body.iloc[0].items() if k not in names}
        grids = {}
        for b in names:
            kind = kinds[b]
            grid = np.full((side, side), np.nan) if kind == "<f8" else np.zeros((side, side), dtype=kind)
            grid[halo : halo + tile, halo : halo + tile] = np.frombuffer(body[b].iloc[0], dtype=kind).reshape(tile, tile)
            for oy, ox, x in zip(around["oy"], around["ox"], around[b], strict=True):
                rows, cols = parts[oy, ox]
                top, left = halo + oy * tile + rows.start, halo + ox * tile + cols.start
                h, w = rows.stop - rows.start, cols.stop - cols.start
                grid[top : top + h, left : left + w] = np.frombuffer(x, dtype=kind).reshape(h, w)
            grids[b] = grid
        return work(own, int(own["cy"]) * tile - halo, int(own["cx"]) * tile - halo, grids)

    bodies = chips.frame if bodies is None else bodies
    edges = strips(chips, halo) if edges is None else edges
    return bodies.groupBy(*chips.place).cogroup(edges.groupBy(*chips.place)).applyInPandas(run, schema)


Stacked = Callable[[pa.Table, dict[str, np.ndarray]], dict[str, np.ndarray]]


def stacked(chips: Chips, halo: int, work: Stacked, bodies: DataFrame, edges: DataFrame, cells: int = 1_000_000) -> DataFrame:
    """Chips as ``work`` makes them, many in a call, as many as ``cells`` allows. Keys are not null.

    ``work`` takes the places of some chips and, for each band, the stack of their grids with the
    halo around, and returns stacks of the chips' own cells for all bands. So the fixed cost of a
    call is paid per stack and not per chip. Chips are small in bytes and long in work, so their
    tasks aren't merged by bytes.
    """
    tile, names, place, side = chips.tile, [*chips.bands, *chips.flags], chips.place, chips.tile + 2 * halo
    parts, kinds, step = _overlaps(tile, halo), {b: chips.kind(b) for b in names}, max(1, cells // side**2)

    def grids_of(column: pa.Array, kind: str, h: int, w: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, h, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                some = pa.Table.from_batches([batch.slice(at, step)]).combine_chunks()
                around = some["around"].combine_chunks()
                of, strip = pc.list_parent_indices(around).to_numpy(zero_copy_only=False), pc.list_flatten(around)
                oy, ox = (strip.field(k).to_numpy(zero_copy_only=False) for k in ("oy", "ox"))
                grids = {}
                for b in names:
                    kind = kinds[b]
                    grid = np.full((len(some), side, side), np.nan) if kind == "<f8" else np.zeros((len(some), side, side), dtype=kind)
                    grid[:, halo : halo + tile, halo : halo + tile] = grids_of(some[b].combine_chunks(), kind, tile, tile)
                    for dy, dx, rows, cols in parts:
                        mine = np.flatnonzero((oy == -dy) & (ox == -dx))
                        top, left = halo - dy * tile + rows.start, halo - dx * tile + cols.start
                        h, w = rows.stop - rows.start, cols.stop - cols.start
                        grid[of[mine], top : top + h, left : left + w] = grids_of(strip.field(b).take(pa.array(mine)), kind, h, w)
                    grids[b] = grid
                own = some.select(place)
                for b, made in work(own, grids).items():
                    own = own.append_column(b, packed(made))
                yield from own.combine_chunks().to_batches()

    n = int(chips.frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = edges.groupBy(*place).agg(F.collect_list(F.struct("oy", "ox", *names)).alias("around"))
    both = bodies.select(*place, *names).repartition(n, *place).hint("merge").join(met, place, "left")
    return both.select(*place, *names, F.coalesce("around", F.array()).alias("around")).mapInArrow(run, chips.schema([*place, *names]))


def cells(own: dict, keys: tuple[str, ...], at: tuple[np.ndarray, np.ndarray], r0: int, c0: int, **columns: np.ndarray) -> pd.DataFrame:
    """A result of ``work``: keys, row, col and columns of the cells at ``at``."""
    out = pd.DataFrame({"row": at[0] + r0, "col": at[1] + c0} | {k: v[at] for k, v in columns.items()})
    for k in reversed(keys):
        out.insert(0, k, own[k])
    return out
