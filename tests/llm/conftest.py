import os

import pytest

SF = "/root/testdata/sf0.001"

#: Small documents with every awkward case: nulls, empties, ties, copies, clashing columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, row string"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    word = " ".join(f"w{i % 37}x{i % 11}" for i in range(400))
    texts = [None, "", " \t\n", "one", word, word, word + " end", "é ü\n\n" + word, "a▁b  c\x00", "x" * 3000, "\n".join(["same line " * 6] * 9)]
    rows = [(i, t, None, None if i % 3 else "s", None, "k", "z", "r") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "null id text " * 30, "en", "s", 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
