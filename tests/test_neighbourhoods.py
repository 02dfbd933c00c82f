"""Neighbourhood operators against plain restatements, for several tile sizes."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inundata.functions import kernels, scalar
from inundata.operators import delineate, raster, regions, stats


def frame(spark, grid, name="t"):
    r, c = np.indices(grid.shape)
    values = [None if isinstance(x, float) and math.isnan(x) else x for x in grid.ravel().tolist()]
    kind = "boolean" if grid.dtype == bool else "double"
    return spark.createDataFrame(list(zip(r.ravel().tolist(), c.ravel().tolist(), values, strict=True)), f"row int, col int, {name} {kind}")


def fill(mask, diagonal):
    """Region number of each true cell by flood fill."""
    out, n = np.zeros(mask.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not a or not b)]
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        todo = [start]
        out[start] = n
        while todo:
            r, c = todo.pop()
            for a, b in steps:
                x, y = r + a, c + b
                if 0 <= x < mask.shape[0] and 0 <= y < mask.shape[1] and mask[x, y] and not out[x, y]:
                    out[x, y] = n
                    todo.append((x, y))
    return out


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [4, 7, 64])
def test_components(spark, diagonal, tile):
    mask = np.random.default_rng(tile).random((30, 25)) < 0.5
    flags = frame(spark, mask, "flag").where("flag")
    got = {(r.row, r.col): r.region for r in regions.connected_components(flags, diagonal, tile).collect()}
    want = fill(mask, diagonal)
    assert len(got) == mask.sum()
    pairs = {(got[k], want[k]) for k in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def plain_morphology(mask, unit):
    out = mask.copy()
    holes = fill(~out, False)
    for k in range(1, holes.max() + 1):
        if (holes == k).sum() < int(unit):
            out[holes == k] = True
    lab = fill(out, True)
    for k in range(1, lab.max() + 1):
        r, c = np.nonzero(lab == k)
        if max(r.max() - r.min(), c.max() - c.min()) + 1 < int(math.sqrt(4 * unit / math.pi)):
            out[lab == k] = False
    lab = fill(out, True)
    for k in range(1, lab.max() + 1):
        if (lab == k).sum() < unit / 2:
            out[lab == k] = False
    return out


@pytest.mark.parametrize("tile", [8, 50])
def test_morphology(spark, tile):
    mask = kernels.gaussian_smooth(np.random.default_rng(3).random((40, 40)), 1.0) < 0.5
    got = regions.morphology(frame(spark, mask, "flag"), 1200, 100, tile).collect()
    want = plain_morphology(mask, 12)
    assert all(r.flag == want[r.row, r.col] for r in got) and len(got) == 1600


def test_local_thresholds_against_plain_restatements():
    """Minimum error by two plain loops, and smoothing by a plain sum with mirrored borders."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(-9, 1.5, 4000), rng.normal(3, 2.0, 9000)])
    lo, hi = (int(x) for x in np.percentile(values, [0.1, 99.9]))
    bins, best = 10 * (hi - lo + 1), None
    counts = np.zeros(bins)
    for x in values:
        if lo <= x <= hi:
            counts[min(bins - 1, int((x - lo) * bins / (hi - lo)))] += 1
    at = [lo + k * (hi - lo) / bins for k in range(bins)]
    for k in range(1, bins):
        cost = 0.0
        for some in (range(k), range(k, bins)):
            n = sum(counts[i] for i in some)
            mean = sum(counts[i] * at[i] for i in some) / n if n else 0
            var = sum(counts[i] * (at[i] - mean) ** 2 for i in some) / n if n else 0
            cost += n / counts.sum() * (np.log(np.sqrt(var)) - np.log(n / counts.sum())) if var > 1e-9 else np.inf
        if best is None or cost < best[0]:
            best = cost, at[k - 1]
    assert kernels.kittler(values) == pytest.approx(best[1])

    block, sigma = rng.random((9, 14)), 1.2
    radius = int(4 * sigma + 0.5)
    taps = [np.exp(-(k**2) / (2 * sigma**2)) for k in range(-radius, radius + 1)]
    mirror = lambda i, n: (i % (2 * n)) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    want = np.zeros(block.shape)
    for r in range(9):
        for c in range(14):
            for a in range(-radius, radius + 1):
                for b in range(-radius, radius + 1):
                    want[r, c] += taps[a + radius] * taps[b + radius] * block[mirror(r + a, 9), mirror(c + b, 14)] / sum(taps) ** 2
    assert np.allclose(kernels.gaussian_smooth(block, sigma), want)


def sequential_growth(t, mask, rounds=999):
    flooded, seeds = mask.copy(), list(zip(*np.nonzero(mask), strict=True))
    for _ in range(rounds):
        before, after = flooded.copy(), flooded.copy()
        for r, c in sorted(seeds):
            w = (slice(max(0, r - 1), r + 2), slice(max(0, c - 1), c + 2))
            if before[w].all() or min(before[w].shape) < 2:
                continue
            mean = np.nanmean(t[w][before[w]])
            with np.errstate(invalid="ignore"):
                after[w] = before[w] | (t[w] < mean)
        seeds = list(zip(*np.nonzero(after & ~before), strict=True))
        flooded = after
        if not seeds:
            return flooded
    return flooded


@pytest.mark.parametrize("tile, batch", [(256, 16), (5, 1), (7, 2)])
def test_region_growing(spark, tile, batch):
    rng = np.random.default_rng(8)
    t = kernels.gaussian_smooth(rng.standard_normal((18, 15)), 1.0)
    t[4, 5] = np.nan
    mask = np.nan_to_num(t, nan=9.0) < -0.35
    got = delineate.region_growing(frame(spark, t), frame(spark, mask, "mask"), tile=tile, batch=batch).collect()
    want = sequential_growth(t, mask)
    assert all(r.flooded == want[r.row, r.col] for r in got)
    few = delineate.region_growing(frame(spark, t), frame(spark, mask, "mask"), max_rounds=3, tile=tile, batch=batch).collect()
    want = sequential_growth(t, mask, 3)
    assert all(r.flooded == want[r.row, r.col] for r in few)
    empty = delineate.region_growing(frame(spark, t), frame(spark, np.zeros_like(mask), "mask"))
    assert empty.where("flooded").count() == 0


def test_exact_ks_counts_paths():
    from itertools import combinations

    def enumerated(d, n, m):
        worse = total = 0
        for up in combinations(range(n + m), n):
            i = j = 0
            far = 0.0
            for step in range(n + m):
                i, j = (i + 1, j) if step in up else (i, j + 1)
                far = max(far, abs(i / n - j / m))
            total += 1
            worse += far >= d - 1e-12
        return worse / total

    for n, m in ((3, 4), (5, 5), (4, 6)):
        for k in range(1, n * m + 1, 3):
            d = k / (n * m)
            assert kernels.ks_exact(d, n, m) == pytest.approx(enumerated(d, n, m), abs=1e-9)
    a, b = np.arange(60.0), np.arange(60.0) + 30
    assert not kernels.ks_similar(a, b) and kernels.ks_similar(a, a + 0.5)


def test_smoothing_spreads_missing_cells():
    grid = np.zeros((80, 80))
    grid[40, 40] = np.nan
    gone = np.isnan(kernels.gaussian_smooth(grid))
    assert gone[20:61, 20:61].all() and gone.sum() == 41 * 41


def test_bimodality_mask(spark):
    rng = np.random.default_rng(5)
    t = rng.normal(2, 0.3, (60, 60))
    t[:30, :25] = rng.normal(-6, 0.3, (30, 25))
    t[50, 50] = np.nan
    p = delineate.FloodParams(sizes=(20, 30, 60), vote=0.4, least_pixels=50)
    got = {(r.row, r.col): r.mask for r in delineate.bimodality_mask(frame(spark, t), p).collect()}
    hits = np.zeros(t.shape)
    for size in p.sizes:
        for a in range(0, 60, size):
            for b in range(0, 60, size):
                block = t[a : a + size, b : b + size]
                bc = kernels.bimodality(kernels.gaussian_smooth(block), 50)
                if bc > p.bimodality and np.nanmean(block) < 0:
                    hits[a : a + size, b : b + size] += 1
    want = (hits / 3 > 0.4) & np.isfinite(t)
    want = want if want.any() else np.isfinite(t)
    assert all(got[r, c] == want[r, c] for r in range(60) for c in range(60))


@pytest.mark.parametrize("tile, strict, method", [(16, False, "otsu"), (100, True, "otsu"), (16, True, "kittler"), (100, False, "kittler")])
def test_adaptive_threshold_does_not_depend_on_tiles(spark, tile, strict, method):
    rng = np.random.default_rng(6)
    t = rng.normal(1, 0.4, (48, 44))
    t[10:30, 12:30] = rng.normal(-4, 0.4, (20, 18))
    mask = t < -3.8
    p = delineate.FloodParams(halves=(6, 9), unit_m2=900, local_bimodality=0.6, tile=tile, least_pixels=30, strict_edges=strict, method=method)
    got = {(r.row, r.col): r.probability for r in delineate.adaptive_threshold(frame(spark, t), frame(spark, mask, "mask"), -4.0, 0.4, p).collect()}
    votes, visits = np.zeros(t.shape), np.zeros(t.shape)
    for r in range(0, 48, 3):
        for c in range(0, 44, 3):
            if not mask[r, c]:
                continue
            windows = []
            for half in p.halves:
                a, b = max(0, r - half), r + half + 1
                if b > 48:
                    a, b = (48, 48) if strict else (a, 48)
                windows.append((slice(a, b), slice(max(0, c - half), min(44, c + half + 1))))
            bcs = [np.nan_to_num(kernels.bimodality(kernels.gaussian_smooth(t[w]), 30)) if t[w].size else 0.0 for w in windows]
            k = int(np.argmax(bcs))
            w = windows[k] if bcs[k] > p.local_bimodality else windows[-1]
            if t[w].size:
                votes[w] += delineate.local_decision(t[w], mask[w], bcs[k], -4.0, 0.4, p)
                visits[w] += 1
    for (r, c), x in got.items():
        assert x == pytest.approx(votes[r, c] / (visits[r, c] + 1))


def test_constant_and_degenerate_inputs(spark):
    flat = frame(spark, np.full((5, 5), 3.0))
    assert stats.otsu_threshold(flat, "t").first().threshold == 3.0
    assert stats.kittler_threshold(flat, "t").first().threshold is None
    assert stats.bimodality_coefficient(flat, "t").first().bc is None
    two = frame(spark, np.array([[0.0] * 50 + [10.0] * 50]))
    assert 0 < stats.otsu_threshold(two, "t").first().threshold < 10


def test_zero_deviation_gives_infinities(spark):
    rows = [(time, 0, col, 5.0 + (time == 3) * d) for time in (1, 2, 3) for col, d in enumerate((1.0, -1.0, 0.0))]
    w = spark.createDataFrame(rows, "time int, row int, col int, v double")
    got = {r.col: r.t for r in stats.t_scores(w, clip=None).collect()}
    assert got == {0: math.inf, 1: -math.inf, 2: None}


def test_kernels_equal_expressions(spark):
    v = np.random.default_rng(1).normal(0, 3, 500)
    df = spark.createDataFrame(pd.DataFrame({"t": v}))
    assert stats.otsu_threshold(df, "t").first().threshold == pytest.approx(kernels.otsu(v))
    assert stats.kittler_threshold(df, "t").first().threshold == pytest.approx(kernels.kittler(v))
    assert stats.bimodality_coefficient(df, "t").first().bc == pytest.approx(kernels.bimodality(v))


def test_exact_quantiles_of_heavy_tails_ties_and_keys(spark):
    """Against numpy, on values that equal bins would not tell apart."""
    rng = np.random.default_rng(21)
    groups = {"tail": np.exp(rng.normal(0, 6, 20_000)), "ties": rng.integers(0, 4, 9_000).astype(float), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([5.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("tail", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for lo, hi in ((0.0001, 0.9999), (0.01, 0.99), (0.25, 0.5), (0.0, 1.0)):
        got = {r.k: (r.q_lo, r.q_hi) for r in stats.quantiles(df, "v", lo, hi, ("k",)).collect()}
        assert got.pop("none") == (None, None)
        for k, vs in groups.items():
            assert got[k] == pytest.approx((np.quantile(vs, lo), np.quantile(vs, hi)), rel=1e-12), (k, lo, hi)
        whole = stats.quantiles(df.where("k = 'tail'"), "v", lo, hi).first()
        assert tuple(whole) == pytest.approx((np.quantile(groups["tail"], lo), np.quantile(groups["tail"], hi)), rel=1e-12)


def test_growth_rounds_in_tiles_and_in_joins_agree(spark):
    rng = np.random.default_rng(9)
    t = kernels.gaussian_smooth(rng.standard_normal((14, 17)), 1.0)
    mask = t < -0.3
    cells = frame(spark, t).where("(row * 17 + col) % 11 <> 3")  # some pixels are absent
    for strict in (False, True):
        flags = frame(spark, mask, "mask")
        state = cells.join(flags, ["row", "col"]).selectExpr("row", "col", "t", "mask as flooded", "mask as seed")
        for _ in range(2):
            state = delineate.growth_round(state, strict)
        tiled = delineate.region_growing(cells, flags, 2, strict, tile=6)
        assert {tuple(r) for r in state.select("row", "col", "flooded").collect()} == {tuple(r) for r in tiled.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_slope_against_loops(spark, seed):
    z = np.random.default_rng(seed).normal(100, 20, (9, 11))
    z[3, 4] = np.nan
    got = {(r.row, r.col): r.slope for r in raster.slope(frame(spark, z, "dem").where("row <> 7 or col <> 2"), 10.0, 20.0).collect()}
    z[7, 2] = np.nan
    assert set(got) == {(r, c) for r in range(9) for c in range(11) if np.isfinite(z[r, c])}
    for (r, c), s in got.items():
        w = z[r - 1 : r + 2, c - 1 : c + 2] if r and c else np.zeros((0, 0))
        if w.shape != (3, 3) or np.isnan(w).any():
            assert s is None
            continue
        gx = (w[0, 2] + 2 * w[1, 2] + w[2, 2] - w[0, 0] - 2 * w[1, 0] - w[2, 0]) / 80.0
        gy = (w[2, 0] + 2 * w[2, 1] + w[2, 2] - w[0, 0] - 2 * w[0, 1] - w[0, 2]) / 160.0
        assert s == pytest.approx(math.degrees(math.atan(math.hypot(gx, gy))))


def test_standardised_samples_forget_scale(spark):
    rows = [(0, s, float(x) if s == 0 else 50.0 + 9.0 * x) for s in (0, 1) for x in range(40)] + [(1, s, 2.0) for s in (0, 1)]
    samples = spark.createDataFrame(rows, "g int, side int, t double")
    assert {r.g: r.similar for r in delineate.ks_similar(samples, ("g",)).collect()}[0] is False
    got = {r.g: r for r in delineate.ks_similar(samples, ("g",), standardise=True).collect()}
    assert got[0].similar and got[0].d == pytest.approx(0.0, abs=0.03)


def test_flood_time_must_be_the_last(spark):
    stack = spark.createDataFrame([(k, 0, c, float(k * c)) for k in (1, 2, 3) for c in range(4)], "time int, row int, col int, v double")
    assert stats.t_scores(stack, None, flood_time=F.lit(3)).count() == 4
    with pytest.raises(Exception, match="flood time"):
        stats.t_scores(stack, None, flood_time=F.lit(2)).collect()


def test_rings_meet(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    cases = [
        ([(1, 1), (2, 1), (2, 2)], True),  # inside
        ([(-9, -9), (20, -9), (20, 30), (-9, 30)], True),  # around
        ([(-1, 1), (5, 1), (5, 2), (-1, 2)], True),  # across, no corner inside either
        ([(4, 4), (9, 4), (9, 9)], True),  # one point
        ([(5, 0), (9, 0), (9, 4)], False),
        ([(3, 9), (9, 3), (9, 9)], False),  # boxes overlap, shapes don't
        ([(6, 0), (8, 0), (8, 4), (6, 4)], False),  # sides on one line, apart
    ]
    rows = [(i, [(float(x), float(y)) for x, y in ring], [(float(x), float(y)) for x, y in square]) for i, (ring, _) in enumerate(cases)]
    kind = "array<struct<lon: double, lat: double>>"
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}")
    got = {r.i: (r.ab, r.ba) for r in df.select("i", scalar.rings_meet(F.col("a"), F.col("b")).alias("ab"), scalar.rings_meet(F.col("b"), F.col("a")).alias("ba")).collect()}
    assert got == {i: (want, want) for i, (_, want) in enumerate(cases)}
