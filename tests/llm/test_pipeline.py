import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from inundata.llm.linededup import LineDedupParams  # noqa: E402
from inundata.llm.pieces import PieceCodec  # noqa: E402
from tests.llm import test_linededup, test_mixing, test_ngramjoin, test_quality  # noqa: E402


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage against the brute-force version, on what its predecessor kept."""
    import hashlib

    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    first = stages["quality rules"](spark, docs, sf_dir).cache()
    assert first.columns == columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in first.collect()}
    for i, t in texts.items():
        *_, failed = test_quality.brute(t)
        if failed:
            assert i not in kept
        elif not re.search(r"!!|\*\*|##|\$\$|%%|&&|\||(?i:reserved|cookie|terms of|policy|powered by)", t) and all(x.rstrip()[-1:] in ".!?" for x in t.split("\n")):
            assert kept[i] == t

    second = stages["line dedup"](spark, first, sf_dir).cache()
    want = {i: t for i, _, _, t in test_linededup.brute([(r.doc_id, r.text) for r in first.collect()], LineDedupParams())}
    assert second.columns == columns and {r.doc_id: r.text for r in second.collect()} == want

    third = stages["n-gram jaccard join"](spark, second, sf_dir).cache()
    groups = test_ngramjoin.brute([(r.doc_id, r.text) for r in second.collect()])
    assert third.columns == columns
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i, _, c in groups if i == c)

    fourth = stages["source mix"](spark, third, sf_dir).cache()
    rows = [(r.doc_id, r.source, r.text) for r in third.collect()]
    sizes, took = {}, {}
    for i, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for r in fourth.collect():
        took[r.source] = took.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    longest = max(len(t.split()) for _, _, t in rows)
    for s, target in test_mixing.brute_targets(sizes).items():
        assert abs(took.get(s, 0) - target) <= max(0.02 * target, longest)

    codec = PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    last = stages["sentencepiece encoding"](spark, fourth, sf_dir)
    want = sorted((r.doc_id, len(ids := codec.library.encode(r.text)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for r in fourth.collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in last.collect()) == want


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_stages_take_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "").cache()
            docs.count()


def test_null_and_repeated_ids_stay(spark):
    """Long clean documents without ids, two texts under one id, near copies without ids, repeated rows."""

    def text(seed, n=120):
        return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 99991}" for k in range(n))

    rows = [(None, text(1)), (None, text(2)), (None, text(2) + " end"), (5, text(3)), (5, text(4)), (6, text(5)), (6, text(5)), (None, text(5) + " more"), (None, text(6)), (None, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["n-gram jaccard join"](spark, docs, "").cache()
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    two = [x for x in got if x[1].startswith(text(2))]
    assert len(two) == 1
    assert [x for x in got if x not in two] == sorted([(0, text(1)), (5, text(3)), (5, text(4)), (6, text(5)), (0, text(6))])

    from inundata.llm.mixing import mix_sources

    for frame in (kept, docs):
        want, mixed = {}, {}
        for r in mix_sources(frame.withColumn("known", F.col("text"))).collect():
            want[r.row.doc_id, r.row.known] = want.get((r.row.doc_id, r.row.known), 0) + r.copies
        for r in stages["source mix"](spark, frame, "").collect():
            mixed[r.doc_id, r.text] = mixed.get((r.doc_id, r.text), 0) + 1
        assert mixed == {k: n for k, n in want.items() if n} and any(i is None for i, _ in mixed)
