import re
from collections import Counter, defaultdict

import pytest

from inundata.llm import queries
from inundata.llm.mixing import MixParams, mix_sources


def brute_targets(sizes, p=MixParams()):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: p.weights[i % len(p.weights)] for i, s in enumerate(order)}
    target, left, free = {}, p.total * sum(sizes.values()), set(order)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > p.cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = p.cap * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def held(rows, docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, s, t in docs}
    source = {i: s for i, s, t in docs}
    sizes = Counter()
    for i, s, _ in docs:
        sizes[s] += size[i]
    want, took = brute_targets(sizes), defaultdict(int)
    for i, n, of_source, target, taken in rows:
        s = source[i]
        assert n == size[i] and of_source == sizes[s]
        assert target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= taken <= 2 * n and (n == 0 or taken % n == 0)
        took[s] += taken
    return want, took


def test_query_meets_targets_and_repeats(spark, sf_dir):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [tuple(r) for r in queries.op9_source_mix(spark, sf_dir).collect()]
    assert len(rows) == len(docs)
    want, took = held(rows, docs)
    source = {i: s for i, s, _ in docs}
    for s in want:
        # no nearer than documents are small: a copy is a whole document
        own = sorted(n for i, n, *_ in rows if source[i] == s)
        assert abs(took[s] - want[s]) <= max(0.01 * want[s], own[len(own) // 2]), (s, want[s], took[s])
    assert sorted(rows) == sorted(tuple(r) for r in queries.op9_source_mix(spark, sf_dir).collect())


def test_odd_inputs(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.source, r.text) for r in odd_docs.collect()]  # one row has no id, one is there twice
    got = mix_sources(odd_docs).collect()
    assert len(got) == len(docs)
    held([(r.row.doc_id, r.size, r.source_size, r.target, r.size * r.copies) for r in got], docs)
    assert mix_sources(no_docs).count() == 0


def test_many_sizes_in_one_source(spark):
    """20,000 distinct sizes of one source beside small ones; no step gathers a source in one row."""
    import time

    from pyspark.sql import functions as F

    long = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 5_000 + F.col("id") / 7).cast("int")).alias("text"))
    docs = long.unionByName(spark.range(300).select((F.col("id") + 50_000).alias("doc_id"), F.lit("small").alias("source"), F.lit("a b c d e").alias("text")))
    began = time.time()
    got = mix_sources(docs).groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("took"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert time.time() - began < 60
    for r in got:
        assert abs(r.took - r.target) <= 5 and r.most <= 2, r
