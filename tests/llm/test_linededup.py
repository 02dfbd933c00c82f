import hashlib

from inundata.llm import queries
from inundata.llm.linededup import LineDedupParams, dedup_lines

SP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SP))


def brute(docs, p=LineDedupParams()):
    held = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= p.min_chars and len(held[key(x)]) >= p.min_documents and i != max(held[key(x)], key=lambda v: -1 if v is None else v))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op6_line_dedup(spark, sf_dir).collect()
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(docs))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == want
    assert sum(r.n_dropped for r in got) > 0


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op6_line_dedup"]).fetchall()
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op6_line_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_odd_inputs(spark, odd_docs, no_docs):
    line = "  A line that is long enough to count as repeated text. "
    many = "\n".join(f"{line}{k % 2}" if k % 70 else line.upper() for k in range(200))
    docs = odd_docs.select("doc_id", "text", "kept").unionByName(
        spark.createDataFrame([(100 + i, many if i % 2 else line + "\n" + line, "k") for i in range(7)] + [(103, "x\n" + line, "k")], "doc_id long, text string, kept string")
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text or "") for r in dedup_lines(docs).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted(brute(rows), key=order)
    assert dedup_lines(no_docs).count() == 0
