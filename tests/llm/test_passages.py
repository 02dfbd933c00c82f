import hashlib
import random

import numpy as np

from inundata.llm import queries
from inundata.llm.passages import PassageParams, remove_passages, triggers


def brute(docs, length=50):
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(rows):
    return sorted((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in rows)


def test_every_string_has_a_trigger_set_by_its_bytes():
    rng = random.Random(1)
    p = PassageParams()
    texts = [bytes(rng.choices(b"abc ", k=rng.randrange(0, 400))) for _ in range(40)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, at, *_ = triggers(np.frombuffer(b"".join(texts), np.uint8), starts, p)
    for d, t in enumerate(texts):
        own = set(at[doc == d].tolist())
        for k in range(len(t) - p.length + 1):
            assert any(x in own for x in range(k, k + p.length - p.trigger + 1))


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op10_passage_dedup(spark, sf_dir).collect())
    assert got == brute(docs)
    assert sum(r[2] for r in got) > 0


def test_planted_passages(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("etaoin shrdlu éß.") for _ in range(n))
    pool = [text(n) for n in (45, 49, 50, 51, 52, 60, 75, 99, 101, 150, 400)]
    docs = []
    for i in range(120):
        t = text(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 4)):
            src = rng.choice(pool)
            a = rng.randrange(0, 6)
            t += src[a : len(src) - rng.randrange(0, 6)] + text(rng.randrange(0, 40))
        docs.append((i * 3 % 120 if i % 2 else i * 3, t))
    docs = list({i: (i, t) for i, t in docs}.values()) + [(900, "ab" * 200), (901, "ab" * 100 + "c" + "ab" * 30), (902, "a" * 49)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert digest(remove_passages(frame).collect()) == brute(docs)


def test_odd_inputs(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").collect()]
    got = remove_passages(odd_docs).collect()
    assert digest([r for r in got if r.doc_id is not None]) == brute(docs)
    assert [r.spans for r in got if r.doc_id is None] == [[]]
    assert remove_passages(no_docs).count() == 0
