"""Secret scans with built-in functions only: fixed patterns, then a randomness test battery.

Beside three fixed patterns, every long run of token characters is a candidate. Its encoding is
inferred, its characters become numbers of that alphabet, and three tests ask whether they look
drawn at random: chi-squared uniformity over alphabet cells, runs above and below the middle, and
serial correlation at lag one. A candidate must pass the battery, and must be improbable as an
ordinary token: a Markov chain over characters, learned from the candidates of the whole corpus,
is the null, and its likelihood ratio to random draws from the encoding bounds the tail
probability that feeds a false-discovery control over all candidates, with weights by length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inundata.llm.text import cut, let

#: Fixed patterns: kind, a cheap test of whole texts, the pattern, the group whose length counts, its least length.
PATTERNS = (
    ("assign", r"(?i)passw|secret|token|api_?key", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"[0-9a-f]{24}", r"([0-9a-f]{24,})", 1, 24),
)
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,stop:int>>"

#: Fixed alphabets, in the order of their digits.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Alphabet cells of the chi-squared test: as many as five characters each allow, within these bounds.
LEAST_CELLS = 4
PER_CELL = 5
#: All characters of a candidate, by class; the null of ordinary tokens is a chain over them.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-")
CHARS = "".join(CLASSES)
#: Class of the next character after the start and after each class, before any token is seen.
NEXT_CLASS = ((0.45, 0.3, 0.15, 0.1), (0.9, 0.02, 0.03, 0.05), (0.45, 0.48, 0.03, 0.04), (0.04, 0.03, 0.85, 0.08), (0.45, 0.2, 0.25, 0.1))
#: Share of characters of a random string that stand outside its alphabet, as in ``a=`` before it.
OUTSIDE = 0.01


@dataclass(frozen=True)
class SecretParams:
    #: Share of false discoveries allowed among the spans that the battery adds.
    fdr: float = 0.01
    #: A battery result below this rejects randomness.
    min_battery: float = 0.001
    #: Steps of -log10(p) per unit in the corpus-wide histogram, and its end.
    steps: int = 20
    top: int = 60
    #: Share of ordinary tokens that have no lower-case letter.
    capitals: float = 0.1
    #: Transitions that the fixed class table and an even choice in a class count for.
    class_weight: float = 100.0
    char_weight: float = 20.0


def _upper_tail(value: Column) -> Column:
    """P(N(0, 1) > value), by the rational approximation of Abramowitz and Stegun 26.2.17."""

    def tail(z: Column) -> Column:
        def poly(t: Column) -> Column:
            return t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))

        half = F.exp(-z * z / 2.0) / 2.5066282746310002 * let(1.0 / (1.0 + 0.2316419 * F.abs(z)), poly)
        return let(half, lambda h: F.when(z >= 0, h).otherwise(1.0 - h))

    return let(value, tail)


def matches(text: Column, hint: str, pattern: str, group: int, least: int, kind: int) -> Column:
    """Leftmost non-overlapping matches as spans; those whose group is too short are dropped.

    The pieces between matches and the matches alternate, so running sums of their lengths give
    positions, which no built-in expression returns directly. An array that grows by one is copied
    each time, so the sums run in stretches of about the square root of the number of matches.
    """

    def stretch(items: Column) -> Column:
        """The length of a stretch, and its spans as if it began the text."""
        return F.aggregate(
            items,
            F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
            lambda a, m: F.struct(
                (a["at"] + m["gap"] + m["len"]).alias("at"),
                F.concat(
                    a["out"],
                    F.when(
                        m["part"] >= least,
                        F.array(F.struct((a["at"] + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + m["gap"] + m["len"]).alias("stop"))),
                    ).otherwise(F.array().cast(SPAN)),
                ).alias("out"),
            ),
        )

    def moved(stretches: Column) -> Column:
        starts = F.aggregate(stretches, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"])))
        return let(
            starts,
            lambda begin: F.flatten(
                F.transform(
                    stretches,
                    lambda x, i: F.transform(
                        x["out"], lambda s: F.struct((s["start"] + F.get(begin, i)).alias("start"), s["kind"].alias("kind"), (s["stop"] + F.get(begin, i)).alias("stop"))
                    ),
                )
            ),
        )

    def placed(found: Column) -> Column:
        def of(gaps: Column) -> Column:
            items = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m["whole"]).alias("len"), F.length(m["part"]).alias("part")))

            def in_stretches(items: Column) -> Column:
                def by(size: Column) -> Column:
                    count = F.ceil(F.size(items) / size).cast("int")
                    return let(F.transform(F.sequence(F.lit(0), count - 1), lambda k: stretch(F.slice(items, k * size + 1, size))), moved)

                return let(F.ceil(F.sqrt(F.size(items))).cast("int"), by)

            return let(items, in_stretches)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), of)).otherwise(F.array().cast(SPAN))

    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")
    )
    named = F.transform(found, lambda m: F.struct(m["whole"].alias("whole"), m["part"].alias("part")))
    return F.when(text.rlike(hint), let(named, placed)).otherwise(F.array().cast(SPAN))


def running_max(values: Column) -> Column:
    """The largest of an array's numbers up to each place, in stretches as in :func:`matches`."""

    def of(v: Column) -> Column:
        def by(size: Column) -> Column:
            count = F.ceil(F.size(v) / size).cast("int")
            one = lambda part: F.aggregate(part, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.greatest(x, F.coalesce(F.get(a, F.size(a) - 1), x)))))

            def joined(parts: Column) -> Column:
                lead = F.aggregate(parts, F.array(F.lit(-(2**31))), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.element_at(x, -1)))))
                return let(lead, lambda before: F.flatten(F.transform(parts, lambda x, i: F.transform(x, lambda y: F.greatest(y, F.get(before, i))))))

            return let(F.transform(F.sequence(F.lit(0), count - 1), lambda k: one(F.slice(v, k * size + 1, size))), joined)

        return F.when(F.size(v) > 0, let(F.ceil(F.sqrt(F.size(v))).cast("int"), by)).otherwise(F.array().cast("array<int>"))

    return let(values, of)


def apart(base: Column, found: Column) -> Column:
    """For each of ``found`` (start, stop; in order, none overlapping) whether it meets no span of ``base``.

    Both are merged by their starts. A span of ``found`` meets an earlier one of ``base`` when the
    furthest stop so far lies beyond its start, a later one when that begins before its stop.
    """
    end = 2**31 - 1
    both = F.array_sort(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("which"), b["stop"].alias("stop"))),
            F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("which"), c["stop"].alias("stop"))),
        )
    )

    def of(spans: Column) -> Column:
        upto = running_max(F.transform(spans, lambda x: F.when(x["which"] == 0, x["stop"]).otherwise(-1)))
        after = F.reverse(running_max(F.reverse(F.transform(spans, lambda x: F.when(x["which"] == 0, -x["start"]).otherwise(-end)))))

        def free(u: Column, a: Column) -> Column:
            marked = F.transform(spans, lambda x, i: F.when(x["which"] == 1, (F.get(u, i) <= x["start"]) & (-F.get(a, i) >= x["stop"])))
            return F.filter(marked, lambda m: m.isNotNull())

        return let(upto, lambda u: let(after, lambda a: free(u, a)))

    return let(both, of)


def battery(token: Column) -> Column:
    """struct(encoding, body, tests: struct(n, p_random)) of one token.

    p_random: the least of the three tests' p-values times three (1 at most). body: the token
    without its padding.
    """


    def encoded(body: Column) -> Column:
        encoding = (
            F.when(body.rlike("^[0-9a-f]+$"), "hex")
            .when(body.rlike("^[0-9A-F]+$"), "HEX")
            .when(body.rlike("^[A-Z2-7]+$"), "base32")
            .when(body.rlike("[-_]"), "base64url")
            .otherwise("base64")
        )

        def tested(name: Column) -> Column:
            alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), name)

            def digits(a: Column) -> Column:
                return F.filter(F.transform(F.split(body, "(?!^)", -1), lambda c: F.call_function("instr", a, c) - 1), lambda d: d >= 0)

            tests = let(alphabet, lambda a: let(digits(a), lambda v: _tests(v, F.length(a).cast("double"))))
            return F.struct(name.alias("encoding"), body.alias("body"), tests.alias("tests"))

        return let(encoding, tested)

    return let(F.regexp_replace(token, "=+$", ""), encoded)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _tests(v: Column, size: Column) -> Column:
    """The battery on digits ``v`` of an alphabet of ``size``."""
    n = F.size(v).cast("double")
    cells = F.least(size, F.greatest(F.lit(float(LEAST_CELLS)), F.floor(n / PER_CELL).cast("double")))

    def uniform(counts: Column) -> Column:
        """Chi-squared over the alphabet, its characters pooled in cells of as many as possible each."""

        def cell(c: Column, k: Column) -> Column:
            expected = n * (F.ceil((k + 1) * size / cells) - F.ceil(k * size / cells)) / size
            return (c - expected) * (c - expected) / expected

        return _total(F.transform(counts, cell))

    def on_chi(chi: Column) -> Column:
        df = cells - 1
        return _upper_tail((F.pow(chi / df, F.lit(1.0 / 3.0)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

    def runs(u: Column) -> Column:
        """Runs above and below the middle of the alphabet, against their normal limit."""
        count = _total(F.transform(u, lambda x, i: F.when((i > 0) & (F.get(u, i - 1) == x), 0.0).otherwise(1.0)))

        def of(n1: Column) -> Column:
            def spread(mean: Column) -> Column:
                var = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
                return F.when(var > 0, 2 * _upper_tail(F.abs(count - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(0.0)

            return let(2 * n1 * (n - n1) / n + 1, spread)

        return let(_total(u), of)

    def serial(m: Column) -> Column:
        """Correlation of neighbours: near N(-1/n, 1/n) for random digits."""
        var = _total(F.transform(v, lambda d: (d - m) * (d - m)))
        cov = _total(F.transform(v, lambda d, i: F.when(i == 0, 0.0).otherwise((d - m) * (F.coalesce(F.get(v, i - 1), F.lit(0)) - m))))
        return let(var, lambda s: F.when(s > 0, 2 * _upper_tail(F.abs(cov / F.greatest(s, F.lit(1e-9)) + 1.0 / n) * F.sqrt(n))).otherwise(0.0))

    in_cells = F.transform(v, lambda d: F.floor(d * cells / size).cast("int"))
    counts = let(in_cells, lambda at: F.transform(F.sequence(F.lit(0), cells.cast("int") - 1), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("double")))
    middle = F.transform(v, lambda d: F.when(d * 2 >= size, 1.0).otherwise(0.0))
    tested = let(
        let(let(counts, uniform), on_chi),
        lambda p_chi: F.struct(
            F.size(v).alias("n"),
            F.least(F.lit(1.0), 3 * F.least(p_chi, let(middle, runs), let(_total(v) / n, serial))).alias("p_random"),
        ),
    )
    return F.when(F.size(v) >= 16, tested).otherwise(F.struct(F.size(v).alias("n"), F.lit(0.0).alias("p_random")))


def _places(body: Column) -> Column:
    """The place of each pair of neighbours in a table of (previous, next) character.

    Characters count from 1, and 0 is the start, so the pairs of a token are as many as its
    characters. A token without lower-case letters is taken as if written in them.
    """
    wide = len(CHARS)

    def paired(c: Column) -> Column:
        return F.transform(c, lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get(c, i - 1)) * wide + x - 1)

    return let(F.transform(F.split(F.when(body.rlike("[a-z]"), body).otherwise(F.lower(body)), "(?!^)", -1), lambda c: F.call_function("instr", F.lit(CHARS), c)), paired)


def chain(counts: dict[int, float], s: SecretParams = SecretParams()) -> list[float]:
    """ln P(next | previous) by place, from how often ordinary tokens have the pair at each place.

    The class of the next character depends on the class of the previous one; the character inside
    the class on the previous character, where letters count in both cases alike. Fixed counts, even inside a class, stand for what is rare.
    """
    kind = [k for k, c in enumerate(CLASSES) for _ in c]
    wide, low = len(CHARS), CHARS.lower()
    by_class, by_char, by_prev = {}, {}, {}
    for at, n in counts.items():
        prev, x = divmod(at, wide)
        a, folded = (kind[prev - 1] + 1 if prev else 0), (low[prev - 1] if prev else "")
        group = max(kind[x], 1)  # both cases of letters
        for table, key in ((by_class, (a, kind[x])), (by_class, a), (by_char, (folded, low[x])), (by_prev, (folded, group))):
            table[key] = table.get(key, 0.0) + n
    out = []
    for prev in range(wide + 1):
        a, folded = (kind[prev - 1] + 1 if prev else 0), (low[prev - 1] if prev else "")
        for x in range(wide):
            k = kind[x]
            of_class = (by_class.get((a, k), 0.0) + s.class_weight * NEXT_CLASS[a][k]) / (by_class.get(a, 0.0) + s.class_weight)
            of_char = (by_char.get((folded, low[x]), 0.0) + s.char_weight / len(CLASSES[k])) / (by_prev.get((folded, max(k, 1)), 0.0) + s.char_weight)
            out.append(math.log(of_class * of_char))
    return out


def _table(spark: SparkSession, values: list[float]) -> DataFrame:
    """One row, ``chain``: as many numbers as there are pairs of characters."""
    return spark.range(1).select(F.split(F.lit(",".join(f"{x:.5f}" for x in values)), ",").cast("array<float>").alias("chain"))


def _log_ratio(c: Column, table: Column, s: SecretParams) -> Column:
    """ln of a candidate's probability as random draws from its encoding over that as an ordinary token."""
    sizes = F.create_map(*[F.lit(x) for name, a in ALPHABETS.items() for x in (name, float(len(a)))])

    def of(size: Column) -> Column:
        share = F.when(c["body"].rlike("[a-z]"), math.log(1 - s.capitals)).otherwise(math.log(s.capitals))
        ordinary = F.aggregate(_places(c["body"]), share, lambda t, at: t + F.get(table, at))
        outside = F.length(c["body"]) - c["n"]
        return c["n"] * F.log((1 - OUTSIDE) / size) + outside * F.log(OUTSIDE / (len(CHARS) - size)) - ordinary

    return let(F.element_at(sizes, c["encoding"]), of)


def ordinary_chain(candidates: DataFrame, s: SecretParams = SecretParams()) -> DataFrame:
    """One row, ``chain``: the null of ordinary tokens, from all distinct candidates.

    ``candidates``: body, encoding, n. A candidate counts as far as the chain of the fixed counts
    alone holds it for an ordinary token, so that secrets don't teach the null what they look like.
    The counts are as many as there are pairs of characters, whatever the corpus.
    """
    spark = candidates.sparkSession
    share = 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), _log_ratio(F.struct("body", "encoding", "n"), F.col("chain"), s))))
    weighed = candidates.dropDuplicates(["body"]).crossJoin(F.broadcast(_table(spark, chain({}, s)))).select("body", share.alias("w")).where("w > 1e-6")
    counts = weighed.select(F.explode(_places(F.col("body"))).alias("at"), "w").groupBy("at").agg(F.sum("w").alias("n"))
    return _table(spark, chain({r["at"]: r["n"] for r in counts.collect()}, s))


def _p_step(log_ratio: Column, n: Column, s: SecretParams) -> Column:
    """The step of a candidate in the histogram: -log10(p over its weight by length).

    An ordinary token reaches a ratio r with a probability of 1/r at most, in each of the encodings.
    """
    weight = F.least(F.lit(2.0), n / 40.0)
    log_p = F.least(F.lit(0.0), math.log10(len(ALPHABETS)) - log_ratio / math.log(10))
    return F.least(F.lit(s.top * s.steps), F.floor((F.log10(weight) - log_p) * s.steps)).cast("int")


def discovery_step(candidates: DataFrame, s: SecretParams) -> DataFrame:
    """One row, ``cutoff``: the smallest step at which the share of false discoveries holds.

    The step-up rule over all candidates, on a histogram of fixed size: at step k the candidates
    expected by chance are m * 10^(-k / steps), and the rule holds if those are at most the
    allowed share of the candidates at k or above.
    """
    counts = candidates.groupBy("step").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.col("step").desc())
    everything = Window.partitionBy()
    return (
        counts.withColumn("above", F.sum("n").over(above.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("m", F.sum("n").over(everything))
        .where(F.col("m") * F.pow(F.lit(10.0), -F.col("step") / s.steps) <= s.fdr * F.col("above"))
        .agg(F.min("step").alias("cutoff"))
    )


def scan_secrets(docs: DataFrame, text: str = "text", s: SecretParams = SecretParams()) -> DataFrame:
    """``row`` (all input columns) and ``spans``: array of struct(start, kind, stop), in order.

    kind counts in :data:`KINDS`; positions are code points, ends exclusive. Null and empty texts
    have no spans. Repeated rows are scanned each for itself, and each counts in the corpus-wide
    statistics; spans that start together come as the kinds are listed. A very long text is scanned
    whole. An empty table gives an empty table. The texts are read once: their spans and candidates go through the checkpoint
    folder while the corpus-wide null and cut-off are found.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    fixed = F.concat(*[matches(whole, hint, pattern, group, least, k) for k, (_, hint, pattern, group, least) in enumerate(PATTERNS)])
    runs = matches(whole, CANDIDATE, CANDIDATE, 1, 20, 3)

    def tested(found: Column) -> Column:
        return F.transform(
            found,
            lambda x: let(
                battery(F.substr(whole, x["start"] + 1, x["stop"] - x["start"])),
                lambda b: F.struct(x.alias("span"), b["tests"]["n"].alias("n"), b["tests"]["p_random"].alias("p_random"), b["encoding"].alias("encoding"), b["body"].alias("body")),
            ),
        )

    others = [c for c in docs.columns if c != text]
    scanned = cut(
        docs.select(F.struct(*[docs[c] for c in others]).alias("row"), let(fixed, lambda x: F.array_sort(x)).alias("base"), let(runs, tested).alias("tested"))
        .withColumn(
            "tested",
            F.when((F.size("base") == 0) | (F.size("tested") == 0), F.col("tested")).otherwise(
                let(apart(F.col("base"), F.transform("tested", lambda c: c["span"])), lambda free: F.filter("tested", lambda c, i: F.get(free, i)))
            ),
        )
    )
    null = ordinary_chain(scanned.select(F.explode("tested").alias("c")).select("c.body", "c.encoding", "c.n"), s)
    step = lambda c: _p_step(_log_ratio(c, F.col("chain"), s), F.greatest(c["n"], F.lit(1)), s)
    scanned = cut(
        scanned.crossJoin(F.broadcast(null)).select(
            "row", "base", F.transform("tested", lambda c: F.struct(c["span"].alias("span"), c["p_random"].alias("p_random"), step(c).alias("step"))).alias("tested")
        )
    )
    cutoff = discovery_step(scanned.select(F.explode("tested").alias("c")).select("c.step"), s)
    # one row of one number: its size is fixed
    return (
        scanned.crossJoin(F.broadcast(cutoff))
        .select(
            "row",
            F.array_sort(
                F.concat(
                    "base",
                    F.transform(
                        F.filter("tested", lambda c: (c["p_random"] >= s.min_battery) & F.coalesce(c["step"] >= F.col("cutoff"), F.lit(False))),
                        lambda c: c["span"],
                    ),
                )
            ).alias("spans"),
        )
    )
