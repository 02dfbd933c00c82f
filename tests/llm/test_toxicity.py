import random
import zlib

from inundata.llm import queries
from inundata.llm.toxicity import STEMS, Lexicon, fold, learn_lexicon, raw_weight, score_toxicity


def test_fold():
    assert fold("You 1d10t! sсum M0R0N") == " you idiot scum moron "


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op5_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum((s >= 0.5) == (t == 1) for s, t in held) >= 0.95 * len(held)


def test_substitutes_exceptions_and_odd_inputs(spark, odd_docs, no_docs):
    lexicon = Lexicon({"moron": 5.0, "clown": 5.0}, {"circus clown": 5.0}, 2.0, -3.0)
    rows = [(1, "you m0rоn"), (2, "the circus clown smiled"), (3, "a clown"), (4, None), (5, "moronic words")]
    got = {r.doc_id: r.score for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), lexicon).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and got[2] < 0.5 and got[4] < 0.5 and got[5] < 0.5
    assert score_toxicity(odd_docs, lexicon).count() == odd_docs.count()
    assert score_toxicity(no_docs, lexicon).count() == 0
    empty = learn_lexicon(spark.createDataFrame([], "text string, toxic int"))
    assert empty.weights == {} and score_toxicity(odd_docs, empty).count() == odd_docs.count()


def naive(lexicon, text):
    """Every term at every place, without an automaton."""
    words = fold(text).split()
    total = sum(w for term, w in lexicon.weights.items() for x in words if (x.startswith(term[:-1]) if term.endswith("*") else x == term))
    total -= sum(w for phrase, w in lexicon.exceptions.items() for a, b in zip(words, words[1:]) if f"{a} {b}" == phrase)
    return total / max(1, len(words)) ** lexicon.power


def test_automaton_equals_naive_search():
    rng = random.Random(2)
    words = ["clow", "clown", "clowns", "cl0wn", "circus", "moron", "m0ron", "moronic", "an", "idiot", "idio", "x"]
    lexicon = Lexicon({"clow*": 3.0, "moron": 2.0, "an": 0.5, "idio*": 4.0}, {"circus clown": 3.0, "an idiot": 4.5, "moron x": 2.0})
    machine = lexicon.automaton()
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 30)))
        assert abs(raw_weight(machine, text, lexicon.power) - naive(lexicon, text)) < 1e-9, text


def test_exception_phrases_of_words_and_beginnings_are_learned(spark):
    """A word with endings is toxic, but not after "circus"; the phrase must take its weight off."""
    rng = random.Random(6)
    fill = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    text = lambda *extra: " ".join(rng.sample(fill, 30) + list(extra) + rng.sample(fill, 30))
    rows = [(text(f"clown{e}"), 1) for e in ("", "s", "ish", "ery") for _ in range(30)]
    rows += [(text("circus", "clowns"), 0) for _ in range(12)] + [(text(), 0) for _ in range(150)]
    lexicon = learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert any(t.endswith("*") and len(t) - 1 in STEMS for t in lexicon.weights)
    assert "circus clowns" in lexicon.exceptions
    machine = lexicon.automaton()
    assert raw_weight(machine, text("circus", "clowns"), lexicon.power) == 0 < raw_weight(machine, text("a", "clowns"), lexicon.power)
