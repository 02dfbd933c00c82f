"""Texts of half a megabyte among short, null and repeated ones, through every operator on texts."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from inundata.llm.linededup import dedup_lines
from inundata.llm.mixing import mix_sources
from inundata.llm.ngramjoin import jaccard_components
from inundata.llm.passages import remove_passages
from inundata.llm.pieces import encode_pieces
from inundata.llm.quality import apply_quality_rules
from inundata.llm.secrets import scan_secrets
from inundata.llm.sharding import shard_documents
from inundata.llm.toxicity import labelled_sample, learn_lexicon, score_toxicity
from tests.llm.test_quality import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")
_draw = random.Random(11)
LONG = "\n".join(" ".join(f"{_draw.choice(('river', 'gauge', 'rain', 'dam'))}{_draw.randrange(9999)}" for _ in range(12)) + "." for _ in range(5000))
TEXTS = {1: LONG, 2: LONG + " token=abc123def", 3: None, 4: "short", 5: "", 6: "short"}


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(k, t, "s") for k, t in TEXTS.items()], "doc_id long, text string, source string").repartition(3).cache()


def test_quality(long_docs):
    for r in apply_quality_rules(long_docs).collect():
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(TEXTS[r.row.doc_id])


def test_sharding(long_docs):
    got = {r.row.doc_id: r for r in shard_documents(long_docs).collect()}
    assert {k: r.size for k, r in got.items()} == {k: len((t or "").encode()) + 8 for k, t in TEXTS.items()}
    assert got[4].shard == got[6].shard and got[1].shard != got[2].shard


def test_pieces(long_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in encode_pieces(long_docs, MODEL).collect():
        ids = library.encode(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_secrets(long_docs):
    spans = {r.row.doc_id: [(x.start, x.kind, x.stop) for x in r.spans] for r in scan_secrets(long_docs).collect()}
    assert spans == {k: [(len(LONG) + 1, 0, len(TEXTS[2]))] if k == 2 else [] for k in TEXTS}


def test_toxicity(spark, long_docs):
    rows = [(100 + i, f"calm water {i}" if i % 2 else f"vilest water {i}", i % 2 == 0) for i in range(60)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    lexicon = learn_lexicon(labelled_sample(learned.select("doc_id", "text"), learned.select("doc_id", F.col("toxic").cast("int").alias("toxic"))))
    scores = {r.doc_id: r.score for r in score_toxicity(long_docs, lexicon).collect()}
    assert set(scores) == set(TEXTS) and all(0 <= s < 0.5 for s in scores.values()) and scores[4] == scores[6]


def test_line_dedup(long_docs):
    got = {r.row.doc_id: r for r in dedup_lines(long_docs).collect()}
    assert {k: r.n_lines for k, r in got.items()} == {k: (t or "").count("\n") + 1 for k, t in TEXTS.items()}
    assert all((r.n_dropped, r.kept_text or "") == (0, TEXTS[k] or "") for k, r in got.items())


def test_jaccard(long_docs):
    words = LONG.split()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(long_docs).collect()}
    n = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert got == {1: (n, 1), 2: (n + 1, 1), 3: (0, 3), 4: (1, 4), 5: (0, 5), 6: (1, 4)}


def test_mix(long_docs):
    got = {r.row.doc_id: r for r in mix_sources(long_docs).collect()}
    assert {k: r.size for k, r in got.items()} == {k: len((t or "").split()) for k, t in TEXTS.items()}
    assert all(r.copies <= 2 for r in got.values())


def test_passages(long_docs):
    got = {r.doc_id: r for r in remove_passages(long_docs).collect()}
    assert {k: [tuple(x)[:2] for x in r.spans] for k, r in got.items()} == {k: [(0, len(LONG))] if k == 2 else [] for k in TEXTS}
    assert got[2].kept_sha256 == hashlib.sha256(b" token=abc123def").hexdigest()
