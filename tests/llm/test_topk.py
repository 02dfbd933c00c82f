import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inundata.llm import queries
from inundata.llm.topk import SortedLists, TopParams, top_inner_products

COLUMNS = ("query_id", "rank", "vec_id", "score")


def brute(rows, k=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % 50 == 0:
            scores = [(-sum(x * y for x, y in zip(q, v, strict=True)), j is None, j or 0, j) for b, (j, v) in enumerate(kept) if b != a and len(v) == len(q)]
            out += [(i, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def search(frame, p=TopParams()):
    return rows_of(top_inner_products(frame, F.col("vec_id") % 50 == 0, p=p))


def test_query_is_its_sql_and_brute_force(spark, sf_dir):
    got = rows_of(queries.op13_top_inner_products(spark, sf_dir))
    assert got == brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    found = con.execute(queries.TOP_SQL)
    at = [[d[0] for d in found.description].index(c) for c in COLUMNS]
    assert got == sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=repr)


def test_odd_vectors_ties_and_a_large_group(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(12).tolist()
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(400)] + [(1000 + i, base) for i in range(300)]
    rows += [(50, rows[50][1]), (50, rows[60][1]), (None, base), (None, [9.0] * 12), (2000, [0.0] * 12)]
    rows += [(3000, None), (3050, [float("nan")] * 12), (3100, [None] * 12), (3150, [math.inf] * 12), (4000, []), (4001, []), (5000, [1.0, -2.0]), (5001, [1.0, 5.0]), (6000, [1.0] * 7)]
    frame = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, query string, node int").repartition(3)
    want = brute(rows)
    for p in (TopParams(), TopParams(block=64, together=3, readings=4, left=5), TopParams(queries=4, block=50, left=0)):
        assert search(frame, p) == want
    assert search(frame, TopParams(k=1)) == brute(rows, 1)
    assert search(frame.limit(0)) == [] and search(frame.where("vec_id % 50 <> 0")) == []


def test_large_components(spark):
    """Scores beyond what doubles tell apart are exact still; beyond 64 bits the job fails."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-(2**28), 2**28, 8) / 256).tolist()) for i in range(300)]
    assert search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        search(spark.createDataFrame([(0, [1e18, 1.0]), (1, [1.0, 1e300])], "vec_id long, embedding array<double>"))


def test_reading_ends_early():
    """Lists with a few large values are left long before their end, and what is left holds the best."""
    rng = np.random.default_rng(9)
    vectors = np.floor(rng.pareto(1.5, (2000, 6)) * 50) * rng.choice([-1, 1], (2000, 6))
    q = np.floor(rng.standard_normal((20, 6)) * 40)
    p = TopParams(left=8, readings=40)
    c, of, read = SortedLists(vectors).qualified(q, np.full(20, -np.inf), np.zeros((0, 2), dtype=int), p)
    assert read < 500
    exact = vectors @ q.T
    for k in range(20):
        best = np.sort(exact[:, k])[-5]
        assert set(np.flatnonzero(exact[:, k] >= best)) <= set(c[of == k])
