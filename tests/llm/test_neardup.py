import math

import numpy as np

from inundata.llm import queries
from inundata.llm.neardup import NearParams, calibrated_count, near_duplicates, tables_needed


def brute(rows, cosine=0.95):
    ids, vecs = [i for i, _ in rows], []
    for _, v in rows:
        bad = v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v)
        vecs.append(None if bad else np.asarray(v, dtype=np.float64) / np.linalg.norm(np.asarray(v, dtype=np.float64)))
    n, root = [0] * len(ids), list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if vecs[a] is not None and vecs[b] is not None and len(vecs[a]) == len(vecs[b]) and float(vecs[a] @ vecs[b]) >= cosine:
                n[a], n[b] = n[a] + 1, n[b] + 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, n[k], least[find(k)], least[find(k)] == i) for k, i in enumerate(ids))


def test_calibration():
    p = NearParams()
    assert tables_needed(p, 16) == math.ceil(math.log(0.002 / 3) / math.log(1 - (1 - math.acos(0.95) / math.pi) ** 16))
    assert 18 <= calibrated_count(p) <= 22


def test_query_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, got = brute(rows), sorted(tuple(r) for r in queries.op8_embedding_near_dup(spark, sf_dir).collect())
    assert len(got) == len(want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)


def test_odd_vectors_copies_and_a_large_group(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.12 * rng.standard_normal(16)).tolist()) for i in range(90)]
    rows += [(100 + i, rng.standard_normal(16).tolist()) for i in range(60)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [2 * x for x in rows[3][1]])]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, []), (305, [1.0, 2.0]), (306, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, kept string").repartition(3)
    want = brute(rows)
    for block in (2048, 16):
        got = sorted(tuple(r) for r in near_duplicates(frame, p=NearParams(block=block, miss=1e-6)).collect())
        assert got == want
    assert near_duplicates(frame.limit(0)).count() == 0


def test_huge_components_do_not_overflow(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal(12)
    rows = [(1, (x * 1e200).tolist()), (2, (x * 1e-200).tolist()), (3, (-x * 1e200).tolist()), (4, x.tolist())]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False)]


def test_recall_at_the_threshold(spark):
    """3,000 vectors, a third in groups whose cosines lie around the threshold, one group of 300."""
    rng = np.random.default_rng(5)
    vecs = list(rng.standard_normal((2000, 64)))
    for group in [300] + [10] * 70:
        base = rng.standard_normal(64)
        vecs += [base + 0.212 * rng.standard_normal(64) for _ in range(group)]
    x = np.array(vecs, dtype=np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(5)
    got = np.array([r.n_links for r in sorted(near_duplicates(frame).collect(), key=lambda r: r.vec_id)])
    assert 0.2 * 300 < want[2000:2300].mean() < 0.9 * 300
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
