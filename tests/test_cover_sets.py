"""Tile sets that cover an area."""

import random
from itertools import combinations

import pytest

from inundata.operators import catalogue


def brute(cover, cells):
    for k in range(1, len(cover) + 1):
        for names in combinations(sorted(cover), k):
            if set().union(*(cover[t] for t in names)) >= set(range(cells)):
                return list(names)
    return None


def found(spark, cover, cells):
    rows = spark.createDataFrame([(t, list(c)) for t, c in cover.items()], "tile string, cells array<int>")
    got = catalogue.tile_cover_set(rows, cells).collect()
    return got[0].tiles if got else None


@pytest.mark.parametrize("seed", range(4))
def test_against_all_sets(spark, seed):
    rng = random.Random(seed)
    cells = rng.choice((5, 9, 70))
    cover = {f"t{k:02d}": set(rng.sample(range(cells), rng.randrange(1, cells // 2 + 1))) for k in range(9)}
    assert found(spark, cover, cells) == brute(cover, cells)


def test_odd_covers(spark):
    assert found(spark, {"a": {0, 1}, "b": {3}}, 4) is None
    assert found(spark, {"b": {0, 1, 2, 9}, "a": {0, 1}, "c": {0, 1, 2}}, 3) == ["b"]
    assert found(spark, {"a": {0}, "b": {0, 1}, "c": {1, 2}}, 3) == ["a", "c"]  # a is no use to b, but comes first
    empty = spark.createDataFrame([(None, [0]), ("x", None)], "tile string, cells array<int>")
    assert catalogue.tile_cover_set(empty, 1).count() == 0


def test_sixty_tiles_that_need_twelve(spark):
    """Three cells a tile around a ring of 36, and smaller tiles that are no help."""
    cover = {f"t{k:02d}": {k, (k + 1) % 36, (k + 2) % 36} for k in range(36)}
    cover |= {f"u{k:02d}": {k, (k + 1) % 36} for k in range(24)}
    assert len(cover) == 60
    assert found(spark, cover, 36) == [f"t{k:02d}" for k in range(0, 36, 3)]
