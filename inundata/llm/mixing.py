"""Mixing sources to target weights by entropy balancing, with built-in functions only.

Documents get rates that stay as near to one as they can, in entropy, while each source's
expected words meet its target. The convex dual has one multiplier per source: a document's rate
is the exponential of multiplier times relative size, and no more than the cap. Distributed
Newton iterations on a histogram of (source, size) solve it; the rates are then rounded into whole
copies, size by size, so that what one size has too much the next has too little.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inundata.llm.text import cut, shuffle_width, word_count


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    #: All targets together, as a share of all sizes.
    total: float = 1.5
    #: No document is taken more often, and no target is a larger multiple of its source.
    cap: int = 2
    tolerance: float = 1e-6
    max_iterations: int = 60
    #: Iterations between two cuts of the lineage.
    per_cut: int = 4


def source_targets(hist: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """source, source_size, target: weighted shares of the total, none above its cap.

    Sources in code point order, null last, take the weights in turn. Water filling: with caps
    sorted by cap over weight, the level is that of the first source that stays below its cap.
    The table has a row per source.
    """
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(p.weights)))
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in p.weights]), turn + 1)).withColumn(
        "most", (F.col("source_size") * p.cap).cast("double")
    )
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * p.total - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / (
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    )
    filled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(order))
    below = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct("place", "level"))
    return filled.withColumn("best", F.min(below).over(everything)["level"]).select(
        "source", "source_size", F.when(F.col("best").isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * F.col("best"))).alias("target")
    )


def _rate(lam: Column, size: Column, mean: Column, cap: int) -> Column:
    x = lam * size / mean
    return F.when(x >= F.log(F.lit(float(cap))), F.lit(float(cap))).otherwise(F.exp(F.greatest(x, F.lit(-700.0))))


def solve_rates(hist: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """source, lam, mean, full: multipliers from Newton steps kept inside a bracket.

    ``full`` marks sources whose target is their cap: every document is taken ``cap`` times.
    """
    base = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    state = cut(
        targets.join(base, targets["source"].eqNullSafe(base["source"]))
        .select(
            targets["source"],
            "target",
            "mean",
            (F.col("target") >= F.col("source_size") * p.cap * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("lam"),
            F.lit(-700.0).alias("lo"),
            (F.log(F.lit(float(p.cap))) * F.col("mean") / F.coalesce("least", F.lit(1)) + 1.0).alias("hi"),
            F.lit(float("inf")).alias("miss"),
        )
        .repartition(shuffle_width(hist.sparkSession), "source")
    )
    kept = [c for c in state.columns if c != "source"]
    worst = None
    for turn in range(1, p.max_iterations + 1):
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), p.cap)
        part = F.col("size") * F.col("n")
        sums = (
            hist.alias("h")
            .join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("h.source").alias("source"))
            .agg(
                *[F.first(c).alias(c) for c in kept],
                F.sum(part * rate).alias("got"),
                F.sum(F.when(rate < p.cap, part * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
            )
        )
        over = F.col("got") - F.col("target")
        close = F.abs(over) <= p.tolerance * F.greatest(F.col("target"), F.lit(1.0))
        step = F.col("lam") - over / F.greatest(F.col("slope"), F.lit(1e-9))
        state = (
            sums.withColumn("lo", F.when(over > 0, F.col("lo")).otherwise(F.col("lam")))
            .withColumn("hi", F.when(over > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("miss", F.abs(over) / F.greatest(F.col("target"), F.lit(1.0)))
            .withColumn("lam", F.when(close, F.col("lam")).when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2))
            .select("source", *kept)
        )
        if turn % p.per_cut == 0:
            state = cut(state)
            worst = state.where(~F.col("full")).agg(F.max("miss")).first()[0]
            if worst is None or worst <= p.tolerance:
                break
    else:
        raise RuntimeError(f"rates miss their targets by {worst} after {p.max_iterations} iterations")
    return state.select("source", "lam", "mean", "full")


def whole_copies(hist: DataFrame, targets: DataFrame, rates: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """source, size, n, total: copies that the n documents of one size get together.

    Running sums of the expected copies over a source's sizes are rounded, so errors cancel
    between neighbouring sizes, and what is left of a target is less than its largest size. That
    goes, round after round, to the largest size that still fits, until none does; a round leaves
    less than that size or uses it up. It is an aggregate per source and a join, whatever the
    number of sizes.
    """
    running = Window.partitionBy("source").orderBy("size")
    joined = (
        hist.alias("h")
        .join(rates.alias("r"), F.col("h.source").eqNullSafe(F.col("r.source")))
        .join(targets.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")))
        .select(
            "h.source", "h.size", "h.n", "t.target", "full",
            F.when(F.col("full"), F.lit(float(p.cap))).otherwise(_rate(F.col("lam"), F.col("h.size"), F.col("mean"), p.cap)).alias("rate"),
        )
    )
    upto = F.floor(F.sum(F.col("rate") * F.col("n")).over(running) + 0.5)
    rounded = joined.withColumn("upto", upto).withColumn(
        "total", F.least(F.col("n") * p.cap, F.greatest(F.lit(0), F.col("upto") - F.coalesce(F.lag("upto").over(running), F.lit(0)))).cast("long")
    )
    dealt = cut(rounded.select("source", "size", "n", "target", "total"))
    gap = F.sum(F.col("total") * F.col("size"))
    while True:
        gaps = dealt.groupBy("source").agg((F.first("target") - gap).alias("gap"))
        room = F.when(F.col("gap") >= 0, F.col("n") * p.cap - F.col("total")).otherwise(F.col("total"))
        fits = F.least(room, F.floor(F.abs("gap") / F.col("size")))
        picked = (
            dealt.alias("d")
            .join(gaps.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
            .where((F.col("size") > 0) & (F.abs("gap") >= F.col("size")) & (room > 0))
            .groupBy(F.col("d.source").alias("source"))
            .agg(F.max_by(F.struct("size", (fits * F.signum("gap")).cast("long").alias("move")), "size").alias("pick"))
        )
        picked = cut(picked)
        if picked.isEmpty():
            break
        move = F.when(F.col("d.size") == F.col("pick.size"), F.col("pick.move")).otherwise(0)
        dealt = cut(
            dealt.alias("d")
            .join(picked.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")), "left")
            .select("d.source", "d.size", "d.n", "d.target", (F.col("d.total") + F.coalesce(move, F.lit(0))).cast("long").alias("total"))
        )
    return dealt.select("source", "size", "n", "total")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", p: MixParams = MixParams()) -> DataFrame:
    """``row`` (input columns but the text), ``text_hash``, ``size``, ``source_size``, ``target``, ``copies``.

    Null and blank texts have size 0, which no mix counts; they keep one copy. Null is a source of
    its own, the last. Repeated rows count each for itself. An empty table gives an empty table; a
    very long text is one document like any other, and limits how near its source's target is met. The order of documents within one
    size comes from a hash of the id, so that reruns agree.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text]
    sized = cut(
        docs.select(
            F.struct(*[docs[c] for c in others]).alias("row"), docs[source].alias("source"), docs[id_col].alias("id"), F.xxhash64(docs[text]).alias("text_hash"), word_count(docs[text]).alias("size")
        )
    )
    hist = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = cut(source_targets(hist, p))
    copies = whole_copies(hist, targets, solve_rates(hist, targets, p), p)
    # ranks within one (source, size), through salted parts, as one size may hold a third of all rows
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("id", "text_hash"), F.lit(shuffle_width(spark))))
    parts = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("skip", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    dealt = (
        offsets.alias("o")
        .join(copies.alias("c"), F.col("o.source").eqNullSafe(F.col("c.source")) & (F.col("o.size") == F.col("c.size")))
        .join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
        .select("o.source", "o.size", "o.salt", "skip", "n", "total", "source_size", "target")
    )
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("id", "text_hash")))
    place = F.col("skip") + F.col("rank") - 1
    extra = (place < F.pmod("total", F.col("n"))).cast("int")
    taken = F.when(F.col("d.size") == 0, F.lit(1)).otherwise((F.floor(F.col("total") / F.col("n")) + extra).cast("int"))
    return (
        ranked.alias("r")
        .join(dealt.alias("d"), F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.size") == F.col("d.size")) & (F.col("r.salt") == F.col("d.salt")))
        .select("r.row", "r.text_hash", F.col("r.size").alias("size"), "source_size", "target", taken.alias("copies"))
    )
