import random
import re

import numpy as np

from inundata.llm import queries
from inundata.llm.ngramjoin import CountTree, count_vector, jaccard_components, shingle_set


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in sets:
        for x in s:
            by.setdefault(x, set()).add(i)
    size = dict(sets)
    seen = {(a, b) for ids in by.values() if len(ids) > 1 for a in ids for b in ids if a < b}
    for a, b in seen:
        both = len(size[a] & size[b])
        if 100 * both >= 80 * len(size[a] | size[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op7_ngram_jaccard(spark, sf_dir).collect())
    assert got == brute(docs)


def test_planted_pairs_at_the_threshold(spark):
    rng = random.Random(7)
    docs, i = [], 0
    for n in (4, 5, 6, 8, 9, 13, 20, 45, 90, 200, 500):
        for trial in range(6):
            words = [f"q{rng.randrange(10**6)}" for _ in range(n)]
            docs.append((i, " ".join(words)))
            more = list(words)
            for _ in range(rng.choice((1, max(1, n // 45), max(1, n // 20)))):
                more[rng.randrange(n)] = f"z{rng.randrange(10**6)}"
            docs.append((i + 1, " ".join(more)))
            docs.append((i + 2, " ".join(words + [f"e{k}" for k in range(max(1, n // (4 + trial)))])))
            docs.append((i + 3, " ".join(words).upper()))
            i += 4
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    for _ in range(60):  # one large group of near copies
        w = list(base)
        w[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        w[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
        i += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame).collect())
    assert got == brute(docs)


def test_tree_finds_all_within_bound():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[4:], rng.integers(0, 2**63, 3).astype(np.uint64)])) for s in sets]
    vec, n = np.stack([count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    got = {(q, t) for a, b in CountTree(vec, n).search(vec, n, 80) for q, t in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(q, t) for q in range(80) for t in range(80) if 180 * np.minimum(vec[q], vec[t]).sum() >= 80 * (n[q] + n[t])}
    assert got == want and (0, 40) in got and len(got) < 80 * 80 / 4


def test_odd_inputs(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    got = jaccard_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert sorted({(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None}) == brute(docs)
    assert jaccard_components(no_docs).count() == 0
    assert len(shingle_set(None)) == 0
