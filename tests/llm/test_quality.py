import re

import regex

from inundata.llm import queries
from inundata.llm.quality import BOILERPLATE, MARKS, SEPARATORS, QualityParams, apply_quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def test_counts_equal_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op1_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def line_goes(line):
    """The line rules, one after the other."""
    words, end = re.findall(r"[^\x20\x09-\x0D]+", line), r"(?=[\x20\x09-\x0D]|$)"
    n = len(words)
    if 0 < n < 4 and not regex.fullmatch(r"[\p{Po}\p{Pf}\p{Pe}\"']", words[-1][-1]):
        return True
    if any(m in line for m in MARKS) and 100 * len(re.findall(r"(?:!!|\?\?|\*\*|##|\$\$|%%|&&)[.,]*" + end, line)) > 30 * n:
        return True
    if any(m in line for m in SEPARATORS) and 100 * len(re.findall("[|<>»«›•·]" + end, line)) > 25 * n:
        return True
    return n < 40 and any(b in line.lower() for b in BOILERPLATE)


def test_verdicts_equal_a_plain_restatement(spark, sf_dir):
    """Kept, characters lost and the cleaned text of every document, and of some made of odd lines."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    body = " ".join(f"word{i}" for i in range(60)) + "."
    odd = ["Home | News | About |", "menu", "so it ends.", "wow!! great!! now!!", "see our Privacy Policy here", "  \t ", "a » b » c » d", "three words only", "«quoted»", "x " * 50 + "terms of use"]
    docs |= {10_000 + k: "\n".join([body] * (k % 3) + odd[k % 5 :] + odd[: k % 7]) for k in range(30)}
    got = apply_quality_rules(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()
    size = lambda text: sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", text)))
    taken = 0
    for r in got:
        text, q = docs[r.row.doc_id] or "", r.quality
        clean = "\n".join(line for line in text.split("\n") if not line_goes(line))
        lost = size(text) - size(clean)
        taken += lost > 0
        assert (q.lost_chars, q.clean_text) == (lost, clean), r.row.doc_id
        assert q.kept == (not brute(text)[5] and 100 * lost <= 40 * size(text))
    assert taken > 30


def test_clean_documents_stay_and_junk_goes(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [r for r in queries.op1_quality_rules(spark, sf_dir).collect() if r.doc_id in labels]
    clean = [r.kept or r.base_failed for r in judged if labels[r.doc_id] == 1]
    junk = [r.kept for r in judged if labels[r.doc_id] == 0]
    assert sum(clean) == len(clean)
    assert sum(junk) < 0.25 * len(junk)


def test_odd_inputs(spark, odd_docs, no_docs):
    got = apply_quality_rules(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(r.row.text)
    assert apply_quality_rules(no_docs).count() == 0


def test_lines_that_fail_go(spark):
    text = "\n".join([" ".join(f"word{i}" for i in range(40)) + ".", "Home | News | About |", "menu", "Read our cookie policy."])
    r = apply_quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().quality
    assert r.clean_text == text.split("\n")[0] and r.kept


def test_limits_of_the_caller_decide(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30)) + ".")], "doc_id long, text string")
    assert apply_quality_rules(docs).first().quality.kept
    r = apply_quality_rules(docs, p=QualityParams(min_words=40)).first().quality
    assert r.base_failed and not r.kept


def test_furniture_of_four_languages_goes_and_prose_about_it_stays(spark):
    furniture = [
        "© 2020 Acme, all rights reserved.",
        "Es gelten unsere Nutzungsbedingungen und die DATENSCHUTZERKLÄRUNG.",
        "Tous droits réservés, lisez nos mentions légales.",
        "Consulte la política de privacidad y el aviso legal.",
    ]
    prose = [" ".join(f"{w}{i}" for i in range(45)) + " " + line for w, line in zip(("word", "wort", "mot", "palabra"), furniture, strict=True)]
    docs = [(k, "\n".join([furniture[k], prose[k], "Hier steht ein Satz mit genug Wörtern."])) for k in range(4)]
    got = {r.row.doc_id: r.quality for r in apply_quality_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, text in docs:
        assert got[k].clean_text == text.split("\n", 1)[1] and got[k].kept
