import zlib
from collections import defaultdict

import numpy as np
import pandas as pd

from inundata.llm import queries
from inundata.llm.sharding import ShardParams, difference, shard_documents, shard_groups


def test_difference_keeps_sums_and_balances():
    rng = np.random.default_rng(3)
    sizes = rng.pareto(1.5, 5000) * 1000 + 10
    parts = np.zeros((5000, 24), dtype=np.int64)
    parts[:, 0] = sizes.astype(np.int64)
    total, places = difference(parts)
    again = np.bincount(places[:, 0], weights=parts[:, 0], minlength=24)
    assert (again == total).all()
    assert total.max() - total.min() <= max(2, 0.001 * total.mean()) or total.max() == parts.max()


def test_known_case():
    total, _ = difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert sorted(total) == [14, 16]  # the textbook differencing result


def test_levels_give_balanced_shards(spark):
    rng = np.random.default_rng(5)
    sizes = (rng.pareto(1.2, 3000) * 500 + 9).astype(int)
    groups = spark.createDataFrame(pd.DataFrame({"node": [f"n{i}" for i in range(3000)], "bytes": sizes}))
    got = shard_groups(groups, 3000, ShardParams(fan=900, least_buckets=32, change=100)).toPandas().merge(groups.toPandas(), on="node")
    assert len(got) == 3000
    load = got.groupby("shard")["bytes"].sum()
    assert len(load) == 24
    assert load.max() <= max(1.02 * sizes.sum() / 24, sizes.max())


def test_levels_are_as_even_as_one(spark):
    """60,000 groups of log-normal sizes: at once, and in one and in two levels of bundles."""
    sizes = np.random.default_rng(7).lognormal(6.5, 1.2, 60_000).astype(int) + 8
    groups = spark.createDataFrame(pd.DataFrame({"node": [f"n{i}" for i in range(60_000)], "bytes": sizes})).cache()
    for p in (ShardParams(), ShardParams(fan=20_000, change=4000), ShardParams(fan=2500, least_buckets=64, change=500)):
        got = shard_groups(groups, 60_000, p).join(groups, "node").groupBy("shard").agg({"bytes": "sum", "*": "count"}).toPandas()
        assert got["count(1)"].sum() == 60_000 and len(got) == 24
        assert got["sum(bytes)"].max() - got["sum(bytes)"].min() <= 50  # of 2.2 million bytes a shard


def held(rows, texts):
    slots, shards, load = defaultdict(list), defaultdict(set), defaultdict(int)
    for i, size, crc, shard, slot in rows:
        raw = (texts[i] or "").encode()
        assert size == len(raw) + 8 and crc == zlib.crc32(raw)
        slots[shard].append(slot)
        shards[texts[i]].add(shard)
        load[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    return load


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in queries.op2_sharding(spark, sf_dir).collect()]
    assert len(got) == len(texts)
    load = held(got, texts)
    groups = defaultdict(int)
    for t in texts.values():
        groups[t] += len((t or "").encode()) + 8
    assert max(load.values()) <= max(max(groups.values()), 1.05 * sum(load.values()) / 24)
    assert sorted(got) == sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in queries.op2_sharding(spark, sf_dir).collect())


def test_odd_inputs(spark, odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}  # one row has no id, one is there twice
    got = shard_documents(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.row.doc_id for r in got} == set(texts)
    held([(r.row.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got], texts)
    assert shard_documents(no_docs).count() == 0
