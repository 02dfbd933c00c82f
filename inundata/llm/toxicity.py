"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and digit substitutions to plain letters. Weights
of lexicon terms, and exception phrases (two words that hold a term but are not toxic), come from
labelled rows by counting documents in Spark. A text's weights are summed, exceptions taken off,
and normalised by length; a logistic curve fitted on the same rows makes that a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed homoglyphs (Cyrillic and Greek letters that look Latin), each with its Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Fixed digit and sign substitutions.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Fixed accents that hide plain letters.
ACCENTS = {"à": "a", "á": "a", "â": "a", "ä": "a", "ã": "a", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ò": "o", "ó": "o", "ô": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ç": "c", "ñ": "n"}

#: Lengths of word beginnings that may be terms, for words that take endings.
STEMS = (4, 5, 6)

_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | ACCENTS)
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ToxicityParams:
    #: Least number of toxic documents with a term, its least log odds and log-likelihood ratio.
    min_documents: int = 5
    min_log_odds: float = 1.0
    min_evidence: float = 25.0
    #: Labelled documents that a fit uses at most, the smallest hashes of ids first.
    max_fit_rows: int = 20_000
    #: Length, in words, that the weights are divided by: words ** power.
    length_power: float = 0.25


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -2.0
    power: float = 0.25

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, w in self.weights.items():
            machine.add_word(f" {term[:-1]}" if term.endswith("*") else f" {term} ", w)
        for phrase, w in self.exceptions.items():
            machine.add_word(f" {phrase} ", -w)
        if len(machine):
            machine.make_automaton()
        return machine


def fold(text: str) -> str:
    """The words of ``text``, folded, with one space before, between and after them."""
    return f" {' '.join(_WORD.findall(text.lower().translate(_FOLD)))} "


def raw_weight(machine, text: str | None, power: float) -> float:
    folded = fold(text or "")
    if not len(machine) or len(folded) < 3:
        return 0.0
    found = sum(w for _, w in machine.iter(folded))
    return found / max(1, folded.count(" ") - 1) ** power


def _beginnings(word: str) -> set[str]:
    return {f"{word[:k]}*" for k in STEMS if len(word) > k}


def _as_terms(words: Column) -> Column:
    """``words`` and their beginnings, as the lexicon writes them."""
    starts = F.transform(words, lambda w: F.filter(F.array(*[F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]), lambda x: x.isNotNull()))
    return F.concat(words, F.flatten(starts))


def _tokens(labelled: DataFrame) -> DataFrame:
    """toxic, term: distinct folded words, word beginnings (marked *) and word pairs of each labelled document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            terms = []
            for text in pdf["text"]:
                words = fold(text or "").split()
                starts = set().union(*map(_beginnings, set(words)))
                terms.append([*set(words), *starts, *{f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}])
            yield pd.DataFrame({"toxic": pdf["toxic"], "terms": terms})

    return labelled.select("text", "toxic").mapInPandas(run, "toxic int, terms array<string>").select("toxic", F.explode("terms").alias("term"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """text, toxic of at most ``max_fit_rows`` labelled rows, those with the smallest id hashes.

    The sample of (id, toxic) has that proven bound, so it is broadcast and no text moves.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(p.max_fit_rows)
    return docs.select(docs[id_col].alias("_id"), docs[text].alias("text")).join(F.broadcast(sample), "_id").select("text", "toxic")


def learn_lexicon(labelled: DataFrame, p: ToxicityParams = ToxicityParams()) -> Lexicon:
    """Weights, exceptions and curve from ``labelled`` (text, toxic 0/1), a bounded sample.

    Document counts per term are a Spark aggregation; what comes to the driver is bounded by the
    sample, as a term needs ``min_documents`` of its rows. Without labels of both kinds the lexicon is empty and
    every score is the same.
    """
    rows = labelled.select("text", "toxic").cache()
    try:
        totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        bad, good = totals.get(1, 0), totals.get(0, 0)
        if not bad or not good:
            return Lexicon({}, {}, 0.0, math.log((bad + 0.5) / (good + 0.5)), p.length_power)
        is_bad = F.sum("toxic")
        odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1.0))
        # log-likelihood ratio of the 2 x 2 table of term and label: terms of chance stay below the limit
        def cell(seen, expected):
            return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

        n, hits, share = F.col("n").cast("double"), F.col("bad").cast("double"), bad / (bad + good)
        evidence = (
            cell(hits, n * share) + cell(n - hits, n * (1 - share)) + cell(bad - hits, (bad + good - n) * share) + cell(good - n + hits, (bad + good - n) * (1 - share))
        )
        counted = _tokens(rows).groupBy("term").agg(is_bad.alias("bad"), F.count("*").alias("n")).withColumns({"odds": odds, "evidence": evidence}).cache()
        one_word = ~F.contains("term", F.lit(" "))
        strong = (
            counted.where(one_word & (F.col("bad") >= p.min_documents) & (F.col("odds") >= p.min_log_odds) & (F.col("evidence") >= p.min_evidence))
            .collect()
        )
        weights = _without_nested({r["term"]: (r["evidence"], r["odds"]) for r in strong})
        benign = (
            counted.where(~one_word & (F.col("bad") == 0) & (F.col("n") >= p.min_documents))
            .where(F.arrays_overlap(_as_terms(F.split("term", " ")), F.array(*[F.lit(t) for t in sorted(weights)])) if weights else F.lit(False))
            .collect()
        )
        exceptions = {r["term"]: sum(weights[t] for w in r["term"].split() for t in (w, *_beginnings(w)) if t in weights) for r in benign}
        counted.unpersist()
        slope, offset = _fit_curve(rows, Lexicon(weights, exceptions, power=p.length_power))
        return Lexicon(weights, exceptions, slope, offset, p.length_power)
    finally:
        rows.unpersist()


def _without_nested(found: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Weights of terms; of a word or beginning and a beginning of it, only the one with more evidence."""
    gone = set()
    for term in found:
        for k in STEMS:
            start = f"{term[:k]}*"
            if start != term and start in found and len(term.rstrip("*")) >= k:
                gone.add(term if found[start][0] >= found[term][0] else start)
    return {t: odds for t, (_, odds) in found.items() if t not in gone}


def _with_weight(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The input with a last column ``_weight`` in place of its last column ``text``."""
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for pdf in batches:
            yield pdf[kept].assign(_weight=[raw_weight(machine, t, lexicon.power) for t in pdf["text"]])

    return rows.mapInPandas(run, f"{schema}, _weight double")


def _fit_curve(rows: DataFrame, lexicon: Lexicon, steps: int = 25) -> tuple[float, float]:
    """Logistic curve of the weight by Newton steps over a histogram of weights, at most a bin per row of the sample."""
    binned = _with_weight(rows.select(F.col("toxic").cast("int").alias("toxic"), "text"), lexicon)
    bins = binned.groupBy(F.round(F.col("_weight") * 20).alias("x"), "toxic").agg(F.count("*").alias("n")).collect()
    a, b = 0.0, 0.0
    for _ in range(steps):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for r in bins:
            x, n = r["x"] / 20, r["n"]
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            g0, g1 = g0 + n * (q - r["toxic"]), g1 + n * (q - r["toxic"]) * x
            h00, h01, h11 = h00 + n * q * (1 - q), h01 + n * q * (1 - q) * x, h11 + n * q * (1 - q) * x * x
        g0, g1, h00, h11 = g0 + 0.01 * b, g1 + 0.01 * a, h00 + 0.01, h11 + 0.01
        det = h00 * h11 - h01 * h01
        b -= (h11 * g0 - h01 * g1) / det
        a -= (h00 * g1 - h01 * g0) / det
    return a, b


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1), one row per input row; nothing is shuffled.

    Null and empty texts have no weight and get the curve's value at zero. Columns beside the
    two named ones are not read. Repeated rows are scored alike, each for itself; a very long text
    is matched whole. An empty table gives an empty table.
    """
    weighed = _with_weight(docs.select(docs[id_col].alias("_id"), docs[text].alias("text")), lexicon)
    return weighed.select(F.col("_id").alias(id_col), (1 / (1 + F.exp(-(F.lit(lexicon.slope) * F.col("_weight") + F.lit(lexicon.offset))))).alias("score"))
