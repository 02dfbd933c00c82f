"""What each filter of a chain takes, alone and in every order, from one pass over the documents.

A document is counted once, under the set of filters that it fails; the table of those counts is
small, 2^n rows a part. The subsets of filters are the states of a lattice: a state is the set of
filters applied so far, an edge applies one more. Counting paths forward gives the number of orders
that reach a state, counting backward the number that go on from it. A removal on an edge happens in
as many orders as lead to its start times as many as leave its end, which weights it for the Shapley
sum; the steps of each single order are read off the same edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inundata.llm.text import let, words

#: The filters of ``failure_flags``, in the order of their bits.
NAMES = ("A", "B", "C", "D", "E")
COUNTS = ("n", "good", "toxic")


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """forward, backward: orders that reach each state from the empty one, and that go on to the full one."""
    forward, backward = [0] * (1 << n), [0] * (1 << n)
    forward[0] = backward[-1] = 1
    for state in range(1 << n):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(1 << n)):
        for f in range(n):
            if state >> f & 1:
                backward[state ^ 1 << f] += backward[state]
    return forward, backward


def failure_flags(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id, part, text_key, mask: bits of the failed filters A to D; E needs other rows, see ``audit_texts``."""
    return docs.select(
        docs[id_col].alias("id"),
        F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(docs[text], F.lit("")), 256).alias("text_key"),
        let(F.coalesce(docs[text], F.lit("")), _text_mask).alias("mask"),
    )


def _text_mask(text: Column) -> Column:
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def of_words(w: Column) -> Column:
        tests = (F.size(w) < 200, 100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]"))
        mask = F.lit(0)
        for bit, failed in enumerate(tests):
            mask = mask + F.when(failed, 1 << bit).otherwise(0)
        return mask

    return let(words(text), of_words)


def failure_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, copies (bit 4) among them.

    Only digests, ids and flags are shuffled. Copies of one text meet as counts by id, then by
    part and label, so a text that a third of the documents share is a few rows where its first
    id is found. A null id is smaller than none and larger than none: such a row is no copy.
    """
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    by_id = flagged.groupBy("id", "text_key", "part", "mask").agg(F.count("*").alias("n"))
    # rows without id are dealt by their text, or all of them would meet in the join
    spread = F.when(F.col("id").isNull(), F.xxhash64("text_key")).otherwise(F.lit(0).cast("long"))
    known = by_id.withColumn("spread", spread).join(marks.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left")
    no = F.lit(False)
    by_text = known.groupBy("text_key", "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    firsts = by_text.groupBy("text_key").agg(F.min("first.id").alias("least"))
    # rows with the least id of their text are no copies, however often they are repeated
    original = F.col("without_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = by_text.join(firsts, "text_key").select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), original.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - original).alias("n")))).alias("of")
    )
    n = F.col("of.n")
    return split.where(n > 0).groupBy("part", F.col("of.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )


def lattice_states(counts: DataFrame, n: int) -> DataFrame:
    """part, states: for each state (a number of n bits) the documents that pass all its filters.

    Each row of the counts goes to the states that share no bit with its mask; a part then has one
    row with at most 2^n entries.
    """
    passed = F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: s.bitwiseAND(F.col("mask")) == 0)
    survivors = counts.select("part", F.explode(passed).alias("state"), *COUNTS).groupBy("part", "state").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return survivors.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct(*COUNTS)))).alias("states"))


def _at(state: Column, count: str) -> Column:
    return F.coalesce(F.try_element_at("states", state)[count], F.lit(0)).cast("long")


def audit_orders(states: DataFrame, names: Sequence[str]) -> DataFrame:
    """part, filter_order, step, filter and the counts of each step of every order of the filters.

    ``redundant`` fail the step's filter but went before, ``unique_fails`` fail no other filter.
    There are n! orders, so this is for a handful of filters; edges and sums need only 2^n states.
    """
    n = len(names)
    forward, backward = path_counts(n)
    full = (1 << n) - 1
    edges = [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << n) for f in range(n) if not s >> f & 1]

    def shapley(f: int) -> Column:
        """Removals of one filter over all its edges, each as often as orders take that edge."""
        total = F.lit(0).cast("long")
        for state, of, paths in edges:
            if of == f:
                total = total + F.lit(paths) * (_at(F.lit(state), "n") - _at(F.lit(state | 1 << f), "n"))
        return total

    per_filter = F.array(
        *[
            F.struct(
                shapley(f).alias("shapley"),
                (_at(F.lit(0), "n") - _at(F.lit(1 << f), "n")).alias("fails"),
                (_at(F.lit(full ^ 1 << f), "n") - _at(F.lit(full), "n")).alias("unique_fails"),
            )
            for f in range(n)
        ]
    )
    orders = "array({})".format(", ".join("array({})".format(", ".join(map(str, o))) for o in permutations(range(n))))
    named = F.array(*[F.lit(name) for name in names])
    steps = (
        states.select("part", "states", per_filter.alias("per_filter"))
        .select("*", F.explode(F.expr(orders)).alias("order"))
        .select("*", F.posexplode("order").alias("pos", "f"))
        .withColumn("before", F.expr("aggregate(slice(order, 1, pos), 0, (s, x) -> s | shiftleft(1, x))"))
        .withColumn("after", F.expr("before | shiftleft(1, f)"))
    )
    gone = {c: _at(F.col("before"), c) - _at(F.col("after"), c) for c in COUNTS}
    own = F.get("per_filter", F.col("f"))
    return steps.select(
        "part",
        F.array_join(F.transform("order", lambda x: F.get(named, x)), "").alias("filter_order"),
        (F.col("pos") + 1).cast("int").alias("step"),
        F.get(named, F.col("f")).alias("filter"),
        _at(F.col("after"), "n").alias("kept"),
        gone["n"].alias("removed"),
        (own["fails"] - gone["n"]).alias("redundant"),
        own["unique_fails"].alias("unique_fails"),
        gone["good"].alias("good_lost"),
        gone["toxic"].alias("toxic_lost"),
        own["shapley"].alias("shapley"),
    )


def audit_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five text filters audited in every order, for each language.

    Null texts are empty, null languages the part ``''``. Repeated rows count each; rows that
    repeat the least id of a text are no copies. A null id has no label and is no copy of
    anything. Labels that are null or missing count for neither; of several labels of one document
    the larger value holds, and labels of no document change nothing. Texts count as identical by
    their SHA-256. Extra columns are not looked at. An empty table has no parts, so no rows.
    """
    return audit_orders(lattice_states(failure_counts(failure_flags(docs), labels), len(NAMES)), NAMES)
