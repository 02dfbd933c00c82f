"""Flood delineation on score rasters: bimodality mask, local thresholds, region growing."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inundata.functions import kernels
from inundata.operators import halo
from inundata.operators.keyed import with_key_rows
from inundata.operators.scans import running_sums
from inundata.sources.folders import cut, fresh


@dataclass(frozen=True)
class FloodParams:
    bimodality: float = 0.555
    #: Block sizes of the bimodality mask.
    sizes: tuple[int, ...] = tuple(range(50, 501, 50))
    vote: float = 0.1
    smoothing: bool = True
    unit_m2: float = 4000.0
    pixel_m2: float = 100.0
    #: Half sizes of the local windows, and the coefficient that makes one usable.
    halves: tuple[int, ...] = (15, 20, 25, 30)
    local_bimodality: float = 0.75
    #: Whether windows are smoothed before their coefficient is taken.
    local_smoothing: bool = True
    method: str = "otsu"
    ks_p: float = 0.05
    probability: float = 0.25
    least_percent: float = 10.0
    least_pixels: int = 100
    #: Reproduce the bottom-row rule of the published method, whose window is empty there.
    strict_edges: bool = False
    tile: int = 128


def _grid(pdf: pd.DataFrame, r0: int, c0: int, h: int, w: int, column: str = "t") -> np.ndarray:
    out = np.full((h, w), np.nan)
    out[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf[column].to_numpy(dtype=float)
    return out


def block_bimodality(scores: DataFrame, p: FloodParams = FloodParams(), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, size, by, bx, bc, mean, flagged: each block of each size, smoothed first if asked for.

    Pixels are shuffled once, into chips of the sizes' common divisor; blocks are put together from
    chips.
    """
    g = math.gcd(*p.sizes)
    at = (F.pmod("row", F.lit(g)) * g + F.pmod("col", F.lit(g))).cast("int")
    cell = F.struct(at.alias("at"), F.coalesce(F.col("t").cast("double"), F.lit(float("nan"))).alias("t"))
    chips = scores.groupBy(*keys, _chip("row", g).alias("cy"), _chip("col", g).alias("cx")).agg(F.collect_list(cell).alias("cells"))
    sized = chips.select(*keys, "cy", "cx", F.col("cells.at").alias("at"), F.col("cells.t").alias("t"), F.explode(F.array(*[F.lit(s) for s in p.sizes])).alias("size"))
    blocks = sized.withColumns({"by": F.floor(F.col("cy") * g / F.col("size")).cast("int"), "bx": F.floor(F.col("cx") * g / F.col("size")).cast("int")})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size, by, bx = (int(k) for k in key[-3:])
        block = np.full((size, size), np.nan)
        counts, place = pdf["at"].map(len).to_numpy(), np.concatenate(pdf["at"].to_list())
        top, left = (np.repeat(pdf[k].to_numpy() * g - k0 * size, counts) for k, k0 in (("cy", by), ("cx", bx)))
        block[top + place // g, left + place % g] = np.concatenate(pdf["t"].to_list())
        valid = block[np.isfinite(block)]
        bc = kernels.bimodality(kernels.gaussian_smooth(block) if p.smoothing else block, p.least_pixels) if len(valid) else math.nan
        mean = float(valid.mean()) if len(valid) else math.nan
        return pd.DataFrame([(*key[:-3], size, by, bx, None if math.isnan(bc) else bc, None if math.isnan(mean) else mean, bool(bc > p.bimodality and mean < 0))])

    # chips are small in bytes and long in work, so their tasks must not be merged by bytes
    width = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, kinds = blocks.repartition(width, *keys, "size", "by", "bx"), dict(scores.dtypes)
    own = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    return dealt.groupBy(*keys, "size", "by", "bx").applyInPandas(run, f"{own}size int, by int, bx int, bc double, mean double, flagged boolean")


def _chip(place: str, g: int) -> Column:
    return F.floor(F.col(place) / g).cast("int")


def bimodality_mask(scores: DataFrame, p: FloodParams = FloodParams(), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, mask: valid pixels flagged in more than ``vote`` of the sizes; all valid if none is.

    All pixels of a chip are in the same blocks, so votes are counted per chip.
    """
    g = math.gcd(*p.sizes)
    chips_of = lambda b: F.explode(F.sequence((F.col(b) * F.col("size") / g).cast("int"), ((F.col(b) + 1) * F.col("size") / g).cast("int") - 1))
    flags = block_bimodality(scores, p, keys).where("flagged").select(*keys, "size", "bx", chips_of("by").alias("cy")).select(*keys, "cy", chips_of("bx").alias("cx"))
    hits = cut(flags.groupBy(*keys, "cy", "cx").agg(F.count("*").alias("hits")))
    placed = scores.select(*keys, "row", "col", F.col("t").isNotNull().alias("valid"), _chip("row", g).alias("cy"), _chip("col", g).alias("cx")).join(hits, [*keys, "cy", "cx"], "left")
    enough = F.coalesce("hits", F.lit(0)) / float(len(p.sizes)) > p.vote
    chosen = placed.select(*keys, "row", "col", "valid", (F.col("valid") & enough).alias("mask"))
    found = chosen.groupBy(*keys).agg(F.coalesce(F.bool_or("mask"), F.lit(False)).alias("found"))
    met = with_key_rows(chosen, found, keys)
    return met.select(*keys, "row", "col", F.when(F.col("found"), F.col("mask")).otherwise(F.col("valid")).alias("mask"))


def seed_grid(mask: DataFrame, unit_m2: float = 4000.0, pixel_m2: float = 100.0) -> DataFrame:
    """row, col: every g-th row and column where the mask is true, g = whole root of unit / pixel."""
    g = int(math.sqrt(unit_m2 / pixel_m2))
    return mask.where(F.col("mask") & (F.col("row") % g == 0) & (F.col("col") % g == 0)).select("row", "col")


def _window(centre: int, half: int, end: int, strict: bool) -> tuple[int, int]:
    low, high = max(0, centre - half), centre + half + 1
    if high > end:
        if strict:  # the published rule moves the wrong end, which leaves nothing
            return end, end
        high = end
    return low, high


def local_decision(t: np.ndarray, mask: np.ndarray, best: float, mean: float, std: float, p: FloodParams) -> np.ndarray:
    """Flood votes of one window by the rules of local adaptive thresholding."""
    valid = t[np.isfinite(t)]
    if best <= p.local_bimodality:
        return np.zeros_like(mask) if not len(valid) else mask
    threshold = kernels.otsu(valid) if p.method == "otsu" else kernels.kittler(valid)
    with np.errstate(invalid="ignore"):
        low, high = t < threshold, t >= threshold
    if not low.any() or not high.any() or not mask.any() or mask.all():
        return mask
    water, land = t[low], t[high]
    if not (kernels.ks_similar(water, t[mask], p.ks_p) or kernels.darker(water, mean, std)):
        return np.zeros_like(mask)
    land_ok = kernels.brighter(land, mean, std) or kernels.ks_similar(land, t[~mask], p.ks_p)
    return low if land_ok and 100.0 * mask.sum() / len(valid) > p.least_percent else mask


def _coefficients(t: np.ndarray, windows: list[tuple[int, int, int, int]], p: FloodParams, cells: int = 1_000_000) -> np.ndarray:
    """Bimodality of each window (top, bottom, left, right), smoothed first if asked for; 0 where it has none.

    Windows of one shape are smoothed together, as many as ``cells`` allows.
    """
    out = np.zeros(len(windows))
    at = np.array(windows, dtype=np.int64).reshape(-1, 4)
    h, w = at[:, 1] - at[:, 0], at[:, 3] - at[:, 2]
    for shape in np.unique(np.stack([h, w], axis=1)[(h > 0) & (w > 0)], axis=0).tolist():
        of, (rows, cols) = np.flatnonzero((h == shape[0]) & (w == shape[1])), shape
        view = np.lib.stride_tricks.sliding_window_view(t, (rows, cols))
        step = max(1, cells // (rows * cols))
        for k in range(0, len(of), step):
            part = of[k : k + step]
            some = view[at[part, 0], at[part, 2]]
            out[part] = np.nan_to_num(kernels.bimodalities(kernels.smooth_windows(some) if p.local_smoothing else some, p.least_pixels))
    return out


def adaptive_threshold(
    scores: DataFrame, mask: DataFrame, mean: float | None, std: float | None, p: FloodParams = FloodParams(), keys: tuple[str, ...] = (), water: DataFrame | None = None
) -> DataFrame:
    """keys, row, col, probability, flooded: votes of overlapping windows around seeds.

    ``scores``: keys, row, col, t. ``mask``: keys, row, col, mask. The water statistics are ``mean``
    and ``std``, or with keys those of ``water`` (keys, mean, std). Chips take what their seeds'
    windows reach from the chips around; all seeds of a chip are smoothed together. Votes meet by
    pixel.
    """
    reach, g, tile = max(p.halves), int(math.sqrt(p.unit_m2 / p.pixel_m2)), p.tile
    on, kinds = [*keys, "row", "col"], dict(scores.dtypes)
    base = scores.select(*on, "t").join(mask.select(*on, "mask"), on, "left")
    chips = halo.to_chips(base, tile, ("t",), ("mask",), keys)
    # what a key has once: a row each, joined to its chips
    known = scores.groupBy(*keys).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    if water is not None:
        known = known.join(water.select(*keys, "mean", "std"), list(keys)) if keys else known.crossJoin(water.select("mean", "std"))
    else:
        known = known.withColumns({"mean": F.lit(mean).cast("double"), "std": F.lit(std).cast("double")})
    bodies = with_key_rows(chips.frame, known, keys)

    def run(own: dict, r0: int, c0: int, grids: dict[str, np.ndarray]) -> pd.DataFrame:
        t, m, rows, cols = grids["t"], grids["mask"] > 0, int(own["rows"]), int(own["cols"])
        votes, visits = np.zeros(t.shape, dtype=np.int64), np.zeros(t.shape, dtype=np.int64)
        inner = np.zeros(t.shape, dtype=bool)
        inner[reach : reach + tile, reach : reach + tile] = m[reach : reach + tile, reach : reach + tile]
        r, c = np.nonzero(inner)
        seeds = [(int(x) + r0, int(y) + c0) for x, y in zip(r, c, strict=True) if (x + r0) % g == 0 and (y + c0) % g == 0]
        windows = []
        for gr, gc in seeds:
            for half in p.halves:
                a, b = _window(gr, half, rows, p.strict_edges)
                windows.append((a - r0, b - r0, max(0, gc - half) - c0, min(cols, gc + half + 1) - c0))
        coefficients = _coefficients(t, windows, p).reshape(len(seeds), len(p.halves))
        for k in range(len(seeds)):
            best = int(np.argmax(coefficients[k]))
            chosen = best if coefficients[k, best] > p.local_bimodality else len(p.halves) - 1
            a, b, d, e = windows[k * len(p.halves) + chosen]
            if a >= b or d >= e:
                continue
            at = (slice(a, b), slice(d, e))
            votes[at] += local_decision(t[at], m[at], coefficients[k, best], own["mean"], own["std"], p)
            visits[at] += 1
        return halo.cells(own, keys, np.nonzero(visits), r0, c0, votes=votes, visits=visits)

    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "row long, col long, votes long, visits long"
    given = halo.with_halo(chips, reach, run, schema, bodies)
    return vote_probability(scores, given, p.probability, keys)


def vote_probability(pixels: DataFrame, votes: DataFrame, limit: float = 0.25, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, probability, flooded: votes over visits plus one."""
    on = [*keys, "row", "col"]
    sums = votes.groupBy(*on).agg(F.sum("votes").alias("votes"), F.sum("visits").alias("visits"))
    share = F.coalesce(F.col("votes") / (F.col("visits") + 1), F.lit(0.0))
    return pixels.select(*on).join(sums, on, "left").select(*on, share.alias("probability")).withColumn("flooded", F.col("probability") > limit)


def growth_round(state: DataFrame, strict_edges: bool = False) -> DataFrame:
    """One synchronous round: row, col, t, flooded, seed (added in this round).

    Each seed's 3 x 3 window takes the mean score of its flooded cells at the start of the round;
    cells below it are added. Where windows overlap, the last seed in row-major order decides, and
    windows that are wholly flooded don't write.
    """
    edge = state.agg(F.max("row").alias("last_row"))
    around = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    seeds = state.where("seed").select(F.col("row").alias("sr"), F.col("col").alias("sc"))
    if strict_edges:
        seeds = seeds.crossJoin(F.broadcast(edge)).where("sr < last_row").drop("last_row")  # one row
    cells = seeds.withColumn("k", F.explode(around)).select("sr", "sc", (F.col("sr") + F.col("k.r")).alias("row"), (F.col("sc") + F.col("k.c")).alias("col"))
    met = cells.join(state.select("row", "col", "t", "flooded"), ["row", "col"])
    windows = met.groupBy("sr", "sc").agg(
        F.avg(F.when(F.col("flooded"), F.col("t"))).alias("m"),
        F.bool_and("flooded").alias("full"),
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"),
    )
    writes = windows.where("not full and r1 > r0 and c1 > c0").select("sr", "sc", "m")
    said = met.join(writes, ["sr", "sc"]).groupBy("row", "col").agg(F.max_by(F.coalesce(F.col("t") < F.col("m"), F.lit(False)), F.struct("sr", "sc")).alias("add"))
    grown = state.select("row", "col", "t", "flooded").join(said, ["row", "col"], "left")
    new = ~F.col("flooded") & F.coalesce("add", F.lit(False))
    return grown.select("row", "col", "t", (F.col("flooded") | new).alias("flooded"), new.alias("seed"))


def region_growing(
    scores: DataFrame, mask: DataFrame, max_rounds: int = 999, strict_edges: bool = False, tile: int = 256, batch: int = 16, keys: tuple[str, ...] = (), written: list[int] | None = None
) -> DataFrame:
    """keys, row, col, flooded: rounds until nothing is added; an empty mask comes back unchanged.

    A round carries two pixels far, so a chip with a halo of twice ``batch`` goes that many rounds
    alone, many chips in one call. Only chips that have a seed within reach run in a batch: they and the strips around them
    are read, by the bands of chips that hold any, and a new version of them is written; what is
    settled stays as it lies. ``written`` takes the number of chips that each batch has written.
    """
    on = [*keys, "row", "col"]
    m = F.coalesce(F.col("mask"), F.lit(False))
    base = scores.select(*on, "t").join(mask.select(*on, "mask"), on, "left").select(*on, "t", m.alias("flooded"), m.alias("seed"))
    last = {tuple(r[k] for k in keys): r["last"] for r in base.groupBy(*keys).agg(F.max("row").alias("last")).collect()} if strict_edges else {}
    return _Growth(base, tile, 2 * batch, keys).run(max_rounds, batch, last, written)


class _Growth:
    """The chips of a growing flood, in versions: a chip's newest version holds.

    A version has a folder per band of chip rows. There are at most as many bands as shuffle
    partitions, each a file, so files grow with what is written and not with the raster's height.
    """

    def __init__(self, base: DataFrame, tile: int, reach: int, keys: tuple[str, ...]):
        self.spark, self.kinds, self.reach = base.sparkSession, dict(base.dtypes), reach
        self.first = halo.to_chips(base, tile, ("t",), ("flooded", "seed"), keys)
        self.path, self.version = fresh(self.spark, "growth"), 0
        self.names = [*self.first.bands, *self.first.flags]
        self.schema = self.first.schema([*self.first.place, *self.names])
        ends = self.first.frame.agg(F.min("cy"), F.max("cy")).first()
        self.low, self.high = (0, 0) if ends[0] is None else ends
        self.width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _band(self, cy: Column) -> Column:
        """The band of a row of chips; rows beyond the raster count as its first or last."""
        span = math.ceil((self.high - self.low + 1) / self.width)
        return F.floor((F.greatest(F.lit(self.low), F.least(F.lit(self.high), cy)) - self.low) / span).cast("int")

    def _write(self, frame: DataFrame) -> DataFrame:
        """The places of the chips of this version that have seeds."""
        frame.withColumn("band", self._band(F.col("cy"))).repartition(self.width, "band").write.partitionBy("band").parquet(f"{self.path}/version={self.version}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={self.version}")

    def _newest(self, bands: list[int] | None = None) -> DataFrame:
        """The newest version of every chip, or of those in some bands, which prune the files."""
        found = self.spark.read.schema(f"{self.schema}, version int, band int").option("basePath", self.path).parquet(*[f"{self.path}/version={k}" for k in range(self.version + 1)])
        if bands is not None:
            found = found.where(F.col("band").isin(bands))
        place = self.first.place
        return found.groupBy(*place).agg(F.max_by(F.struct(*self.names), "version").alias("_c")).select(*place, "_c.*")

    def _near_seeds(self, chips: DataFrame) -> DataFrame:
        """Places of chips that have a seed, or one of a chip around, within reach."""
        tile, parts, keys = self.first.tile, [(0, 0, slice(None), slice(None)), *halo._overlaps(self.first.tile, self.reach)], self.first.keys

        def places(frames):
            for pdf in frames:
                grids = [np.frombuffer(x, dtype="u1").reshape(tile, tile) for x in pdf["seed"]]
                for dy, dx, rows, cols in parts:
                    has = np.array([bool(g[rows, cols].any()) for g in grids], dtype=bool)
                    yield pdf.loc[has, [*keys]].assign(cy=pdf.loc[has, "cy"] + dy, cx=pdf.loc[has, "cx"] + dx)

        return chips.select(*self.first.place, "seed").mapInPandas(places, self.first.schema(self.first.place)).distinct()

    def run(self, max_rounds: int, batch: int, last: dict, written: list[int] | None) -> DataFrame:
        place, tile, reach, keys = self.first.place, self.first.tile, self.reach, self.first.keys
        active = cut(self._near_seeds(self._write(self.first.frame)))
        far = math.ceil(reach / tile)
        around = F.explode(F.array(*[self._band(F.col("cy") + d) for d in range(-far, far + 1)]))
        while max_rounds > 0:
            # the bands with work or beside it, at most as many numbers as shuffle partitions
            wanted = [r["band"] for r in active.select(around.alias("band")).distinct().collect()]
            if not wanted:
                break
            read = self._newest(sorted(wanted))
            chips = halo.Chips(read, tile, self.first.bands, self.first.flags, keys)
            rounds = min(batch, max_rounds)

            def grow(own: pa.Table, grids: dict[str, np.ndarray], rounds: int = rounds) -> dict[str, np.ndarray]:
                # chips one below the other, with a blank line between
                n, side = grids["t"].shape[:2]
                tall = lambda b, blank: np.pad(grids[b], ((0, 0), (0, 1), (0, 0)), constant_values=blank).reshape(n * (side + 1), side)
                closed = None
                if last:
                    lines = own["cy"].to_numpy()[:, None].astype(np.int64) * tile - reach + np.arange(side + 1)
                    ends = np.array([last[tuple(k[x] for x in keys)] for k in own.select(list(keys)).to_pylist()]) if keys else np.full(n, last[()])
                    closed = (lines >= ends[:, None]).ravel()
                flooded, seed = kernels.grow(tall("t", np.nan), *(tall(b, 0) > 0 for b in (halo.HERE, "flooded", "seed")), rounds, closed)
                new = {b: x.reshape(n, side + 1, side)[:, :side].astype("u1") for b, x in (("flooded", flooded), ("seed", seed))}
                return {b: x[:, reach : reach + tile, reach : reach + tile] for b, x in (grids | new).items()}

            bodies = read.join(active, place, "left_semi")
            edges = halo.strips(chips, reach).join(active, place, "left_semi")
            self.version += 1
            now = self._write(halo.stacked(chips, reach, grow, bodies, edges))
            if written is not None:
                written.append(now.count())
            active = cut(self._near_seeds(now))
            max_rounds -= batch

        def pixels(frames):
            for pdf in frames:
                for own in pdf.to_dict("records"):
                    here, flooded = (np.frombuffer(own[b], dtype="u1").reshape(tile, tile) for b in (halo.HERE, "flooded"))
                    yield halo.cells(own, keys, np.nonzero(here), own["cy"] * tile, own["cx"] * tile, flooded=flooded > 0)

        schema = "".join(f"`{k}` {self.kinds[k]}, " for k in keys) + f"row {self.kinds['row']}, col {self.kinds['col']}, flooded boolean"
        return self._newest().select(*place, halo.HERE, "flooded").mapInPandas(pixels, schema)


def growth_factor(windows: DataFrame, mean: float, std: float, keys: tuple[str, ...]) -> DataFrame:
    """keys, factor: 0 for a median at mean + 2 std or above, 1 below mean, linear between."""
    median = F.median("t")
    return windows.groupBy(*keys).agg(median.alias("m")).select(
        *keys, F.when(F.col("m") >= mean + 2 * std, 0.0).when(F.col("m") < mean, 1.0).otherwise((mean + 2 * std - F.col("m")) / (2 * std)).alias("factor")
    )


def darker_than(groups: DataFrame, mean: float, std: float, keys: tuple[str, ...], brighter: bool = False, limit: float = 5.0) -> DataFrame:
    """keys, holds: group median on the right side of the water mean, and apart from it.

    As published, the group's deviation stands where its mean would be expected.
    """
    own = groups.groupBy(*keys).agg(F.median("t").alias("m"), F.stddev_pop("t").alias("s"))
    side = F.col("m") >= mean if brighter else F.col("m") <= mean
    apart = F.try_divide(F.pow(mean - F.col("s"), F.lit(2.0)), std * std + F.col("s") * F.col("s")) > limit
    return own.select(*keys, F.coalesce(side & apart, F.lit(False)).alias("holds"))


def ks_distance(samples: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, m, d: two-sample distance; ``side`` is 0 or 1, ``t`` the value. Missing values sort last.

    Counts per distinct value and running sums over ranges of values, so no group has to fit a task.
    """
    value = F.coalesce(F.col("t").cast("double"), F.lit(float("nan"))).alias("t")
    by_value = samples.groupBy(*keys, value).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    run = running_sums(by_value, ["t"], {"ra": F.col("a"), "rb": F.col("b")}, keys)
    all_ = samples.groupBy(*keys).agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m")).where("n > 0 and m > 0")
    met = run.join(all_, list(keys)) if keys else run.crossJoin(F.broadcast(all_))  # one row
    return met.groupBy(*keys).agg(F.first("n").alias("n"), F.first("m").alias("m"), F.max(F.abs(F.col("ra") / F.col("n") - F.col("rb") / F.col("m"))).alias("d"))


def ks_similar(samples: DataFrame, keys: tuple[str, ...], p_value: float = 0.05, standardise: bool = False) -> DataFrame:
    """keys, d, similar: unless the exact p-value is below ``p_value``; NULL where a side is empty.

    The p-value comes from (n, m, d) alone, so a group's values never meet. With ``standardise``
    each side is first brought to mean 0 and deviation 1; a constant side is missing everywhere.
    """
    if standardise:
        own = samples.groupBy(*keys, "side").agg(F.avg("t").alias("_m"), F.stddev_pop("t").alias("_s"))
        t = F.try_divide(F.col("t") - F.col("_m"), F.nullif("_s", F.lit(0.0)))
        samples = samples.select(*keys, "side", "t").join(own, [*keys, "side"]).select(*keys, "side", t.alias("t"))

    @F.pandas_udf("boolean")
    def decided(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([kernels.ks_decided(float(x), int(a), int(b), p_value) for x, a, b in zip(d, n, m, strict=True)], dtype=bool)

    found = ks_distance(samples, keys).withColumn("similar", decided("d", "n", "m"))
    return samples.select(*keys).distinct().join(found, list(keys), "left").select(*keys, "d", "similar")


def gaussian_similar(groups: DataFrame, mean: float, std: float, keys: tuple[str, ...], limit: float = 1.0, points: int = 100) -> DataFrame:
    """keys, divergence, similar: symmetric Kullback-Leibler divergence of two Gaussians on a grid."""
    own = groups.groupBy(*keys).agg(F.avg("t").alias("mu"), F.stddev_pop("t").alias("s"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("s > 0")
    grid = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1))
    bell = lambda m, s: F.exp(-0.5 * F.pow((F.col("x") - m) / s, F.lit(2.0))) / s
    both = grid.withColumns({"p": bell(F.col("mu"), F.col("s")) + 1e-300, "q": bell(F.lit(mean), F.lit(std)) + 1e-300})
    sums = both.groupBy(*keys).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    joined = both.join(sums, list(keys)).withColumns({"p": F.col("p") / F.col("sp"), "q": F.col("q") / F.col("sq")})
    div = F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q")))
    return joined.groupBy(*keys).agg(div.alias("divergence")).withColumn("similar", F.col("divergence") < limit)
