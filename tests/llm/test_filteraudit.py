import re
from itertools import permutations
from math import factorial

import duckdb

from inundata.llm import queries
from inundata.llm.filteraudit import audit_orders, audit_texts, failure_counts, lattice_states, path_counts

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """Every order applied to every document."""
    good, toxic, first, rows = {}, {}, {}, []
    for i, quality, bad in labels:
        good[i], toxic[i] = good.get(i, 0) or quality == 1, toxic.get(i, 0) or bad == 1
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        rows.append((lang or "", fails, bool(i is not None and good.get(i)), bool(i is not None and toxic.get(i))))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        made = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                failing = [r for r in own if r[1][f]]
                unique = sum(sum(r[1].values()) == 1 for r in failing)
                made.append((f, (part, "".join(order), k + 1, len(left), len(gone), len(failing) - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone))))
        out += [(*m, shapley[f]) for f, m in made]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_path_counts():
    forward, backward = path_counts(5)
    for state in range(32):
        size = state.bit_count()
        assert (forward[state], backward[state]) == (factorial(size), factorial(5 - size))


def test_odd_documents_against_every_order(spark):
    rich = " ".join(f"w{i}" for i in range(250))
    texts = [rich, rich, rich + " $", rich.upper(), "ab " * 300, "", None, "\t \n", "HI & bye", rich + " end", rich + " $", "é" * 5000 + " Å", "a\x0bb\xa0c"]
    docs = [(i, t, (None, "", "en", "fr")[i % 4]) for i, t in enumerate(texts * 2)]
    docs += [docs[0], docs[1], (None, rich, "en"), (None, rich, "en"), (None, None, None)]
    labels = [(0, 1, 0), (0, None, 1), (1, 0, None), (2, 1, 1), (3, None, None), (4, 1, 1), (999, 1, 1), (None, 1, 1), (13, 1, 0), (14, 1, 1), (25, 0, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, mask string, n int").repartition(3)
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, good string")
    assert rows_of(audit_texts(frame, marks)) == brute(docs, labels)
    assert audit_texts(frame.limit(0), marks).count() == 0
    assert rows_of(audit_texts(frame, marks.limit(0))) == brute(docs, [])


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.FILTER_AUDIT_SQL)
    at = [[d[0] for d in found.description].index(c) for c in COLUMNS]
    assert rows_of(queries.op11_filter_audit(spark, sf_dir)) == sorted(tuple(r[k] for k in at) for r in found.fetchall())


def test_other_filters(spark):
    """Two filters of a user's own: masks 0 to 3, and a part in which one filter takes nothing."""
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 1), ("p", 3, 2, 0, 1), ("q", 2, 4, 4, 4)], "part string, mask int, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit_orders(lattice_states(counts, 2), ("X", "Y")).collect()}
    assert got[("p", "XY", 1)] == ("X", 5, 5, 0, 3, 8) and got[("p", "XY", 2)] == ("Y", 5, 0, 2, 0, 2)
    assert got[("p", "YX", 1)] == ("Y", 8, 2, 0, 0, 2) and got[("p", "YX", 2)] == ("X", 5, 3, 2, 3, 8)
    assert got[("q", "XY", 1)] == ("X", 4, 0, 0, 0, 0) and got[("q", "YX", 1)] == ("Y", 0, 4, 0, 4, 8)


def test_no_text_is_shuffled(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    from inundata.llm.filteraudit import failure_flags

    plan = failure_counts(failure_flags(docs), labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "text#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
