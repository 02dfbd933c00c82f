"""Running sums and chains in ranges."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from inundata.operators import catalogue, scans


def thinned(times, gap):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_sums_over_hot_and_rare_keys(spark, ranges):
    rng = np.random.default_rng(1)
    rows = [("hot", int(k), int(rng.integers(0, 9)), 1) for k in range(300)] + [(f"k{k}", 0, 3, 1) for k in range(30)] + [(None, int(k), 2, 0) for k in range(20)]
    df = spark.createDataFrame(rows, "k string, place int, v int, one int").repartition(5)
    got = {(r.k, r.place): (r.total, r.n) for r in scans.running_sums(df, ["place"], {"total": F.col("v"), "n": F.col("one")}, ("k",), ranges).collect()}
    want, sums = {}, {}
    for k, place, v, one in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        a, b = sums.get(k, (0, 0))
        sums[k] = want[k, place] = (a + v, b + one)
    assert got == want
    alone = scans.running_sums(df.where("k = 'hot'").drop("k"), ["place"], {"total": F.col("v")}, (), ranges)
    assert {r.place: r.total for r in alone.collect()} == {p: t[0] for (k, p), t in want.items() if k == "hot"}
    assert scans.running_sums(df.limit(0), ["place"], {"n": F.col("v")}, ("k",), ranges).count() == 0


@pytest.mark.parametrize("gap", [1, 7, 60, 5000])
def test_passages_compose(gap):
    """What many small ranges do one after the other is what one pass does."""
    rng = np.random.default_rng(gap)
    u = np.unique(rng.integers(0, 4000, 700))
    key = np.sort(rng.integers(0, 3, len(u)))
    u = u + np.where(key == 1, -900, 0)
    order = np.lexsort((u, key))
    key, u = key[order], u[order]
    whole = None
    for part in np.array_split(np.arange(len(u)), 37):
        p = scans.passage(key[part], u[part], gap)
        whole = p if whole is None else whole.then(p, gap)
    ends = {k: thinned(u[key == k].tolist(), gap)[-1] for k in range(3)}
    assert int(whole.after(None, np.array([0]), gap)[0]) == ends[2] and whole.last == 2
    for c in (-2000, int(u[key == 0][0]) - gap // 2):
        alone = None
        own = u[key == 0]
        for part in np.array_split(np.arange(len(own)), 11):
            p = scans.passage(np.zeros(len(part), dtype=int), own[part], gap)
            alone = p if alone is None else alone.then(p, gap)
        assert int(alone.after(0, np.array([c]), gap)[0]) == thinned([c, *[x for x in own.tolist() if x > c]], gap)[-1]


@pytest.mark.parametrize("ranges, fan", [(1, 16), (9, 2), (40, 3)])
def test_chains_against_one_pass(spark, ranges, fan):
    rng = np.random.default_rng(5)
    rows = {("a", int(t)) for t in rng.integers(0, 5000, 900)} | {("b", int(t)) for t in rng.integers(0, 300_000, 300)} | {(None, 5), (None, 9), ("c", 1)}
    df = spark.createDataFrame(sorted(rows, key=str), "k string, u long").repartition(4)
    for gap in (3, 40, 700):
        got = sorted(map(tuple, scans.chain(df, ("k",), "u", gap, ranges, fan).collect()), key=str)
        want = [(k, t) for k in ("a", "b", "c", None) for t in thinned([u for x, u in rows if x == k], gap)]
        assert got == sorted(want, key=str)
    assert scans.chain(df.limit(0), ("k",), "u", 3, ranges, fan).count() == 0


def test_ten_million_times_in_one_unbroken_run(spark):
    """Times 7 ms apart, thinned to 60 s: no gap breaks the run, and ranges share the work."""
    n, step, gap = 10_000_000, 7_000, 60_000_000
    df = spark.range(n).select((F.col("id") * step + F.pmod(F.xxhash64("id"), F.lit(3000))).alias("u"))
    got = [r.u for r in scans.chain(df, (), "u", gap, 16).orderBy("u").collect()]
    assert 1150 < len(got) < 1168 and min(np.diff(got)) >= gap and max(np.diff(got)) < gap + 20_000


def test_thinned_datetimes(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=s)) for k, seconds in ((1, (0, 30, 59, 60, 61, 119, 120, 500)), (2, (5, 5, 64, 66))) for s in seconds] + [(3, None)]
    got = {}
    for r in catalogue.thin_datetimes(spark.createDataFrame(rows, "k int, ts timestamp"), keys=("k",), ranges=3).collect():
        got.setdefault(r.k, []).append(int((r.ts - start).total_seconds()))
    assert {k: sorted(v) for k, v in got.items()} == {1: [0, 60, 120, 500], 2: [5, 66]}
