import hashlib
import math

import duckdb
import numpy as np
import pytest

from inundata.llm import queries
from inundata.llm.centroids import CentroidLists, CentroidParams, centroid_clusters

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute(rows, dim=64, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in set(of):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == k]
            centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, k in last if k == c) for c in range(clusters)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia), sha[k]) for (i, _), (d, k) in zip(kept, last, strict=True)), key=repr)


def rows_of(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def test_query_is_its_sql_and_brute_force(spark, sf_dir):
    got = rows_of(queries.op12_centroid_clusters(spark, sf_dir))
    assert got == brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    found = con.execute(queries.centroid_sql())
    at = [[d[0] for d in found.description].index(c) for c in COLUMNS]
    assert got == sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=repr)


def test_walks_end_at_the_nearest_and_see_ties():
    rng = np.random.default_rng(3)
    for k, dim, spread in ((1, 4, 9), (8, 2, 3), (40, 3, 5), (200, 2, 10_000), (60, 8, 2)):
        centroids = rng.integers(-spread, spread + 1, (k, dim))
        x = rng.integers(-spread - 2, spread + 3, (300, dim))
        distance = np.square(x[:, None, :] - centroids[None]).sum(axis=2)
        cluster, best, compared = CentroidLists(centroids).nearest(x)
        assert (cluster == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()
        if spread == 10_000:  # few dimensions, many centroids: most are never compared
            assert compared < 0.2 * k * len(x)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(64) + 3 * (i % 3)).tolist()) for i in range(80)]
    rows += [(5, rows[5][1]), (7, rows[5][1]), (None, rows[9][1]), (None, rows[8][1]), rows[11], rows[11]]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [None] * 64), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (206, [0.0] * 64)]
    frame = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, cluster string, node int").repartition(3)
    assert rows_of(centroid_clusters(frame)) == brute(rows)
    assert centroid_clusters(frame.limit(0)).count() == 0
    few = frame.where("vec_id in (1, 2, 3)")
    assert rows_of(centroid_clusters(few)) == brute([r for r in rows if r[0] in (1, 2, 3)])
    same = spark.createDataFrame([(i, rows[0][1]) for i in range(30)], "vec_id long, embedding array<double>")
    assert rows_of(centroid_clusters(same)) == brute([(i, rows[0][1]) for i in range(30)])


def test_rows_dealt_otherwise_and_other_parameters(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-9, 9, 5).tolist()) for i in range(150)]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    want = brute(rows, dim=5, clusters=20, rounds=3)
    for parts in (1, 7):
        assert rows_of(centroid_clusters(frame.repartition(parts), p=CentroidParams(clusters=20, rounds=3, dim=5, cells=50))) == want


def test_too_large_components_fail(spark):
    frame = spark.createDataFrame([(1, [2.0**40] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroid_clusters(frame).count()
