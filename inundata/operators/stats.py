"""Per-pixel temporal statistics, quantiles and thresholds.

Grouping keys are parameters, so that many areas and dates run in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inundata.operators.keyed import with_key_rows
from inundata.sources.folders import cut


def weighted_stack(stack: DataFrame, static: DataFrame, value: str = "vv_vh_db") -> DataFrame:
    """time, row, col, v: dB weighted by the cosine of the local incidence angle."""
    return stack.join(static.select("row", "col", "lia"), ["row", "col"], "left").select(
        "time", "row", "col", (F.col(value) * F.cos(F.radians("lia"))).alias("v")
    )


def pre_flood_stats(weighted: DataFrame) -> DataFrame:
    """row, col, mean, std (population), n over all times but the last."""
    last = weighted.agg(F.max("time").alias("last"))
    return (
        weighted.join(F.broadcast(last), F.col("time") < F.col("last"))  # one row, one value
        .groupBy("row", "col")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"))
    )


def t_scores(
    weighted: DataFrame, clip: tuple[float, float] | None = (0.0001, 0.9999), exact: bool = True, flood_time: Column | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """keys, row, col, t: (flood - mean) / (std / sqrt(n)), clipped to two quantiles.

    One pass with conditional aggregates; ``keys`` (area, event) have a last time each. n is the
    number of pre-flood times of the whole stack. A deviation of zero gives an infinity of the
    numerator's sign, NULL when that is zero too. ``exact=False`` takes approximate quantiles, which
    hold less per task. The job fails when the last time isn't ``flood_time``, if that is given.
    Scores are written before they are clipped, and the result reads them there.
    """
    flood = F.max("time")
    if flood_time is not None:
        flood = F.when(flood == flood_time, flood).otherwise(F.raise_error(F.lit("the last image is not that of the flood time")))
    last = weighted.groupBy(*keys).agg(flood.alias("last"), (F.countDistinct("time") - 1).alias("n"))
    timed = with_key_rows(weighted, last, keys)
    before = F.when(F.col("time") < F.col("last"), F.col("v"))
    scored = (
        timed.groupBy(*keys, "row", "col")
        .agg(
            F.avg(before).alias("mean"),
            F.stddev_pop(before).alias("std"),
            F.max(F.when(F.col("time") == F.col("last"), F.col("v"))).alias("flood"),
            F.first("n").alias("n"),
        )
        .withColumn("d", F.col("flood") - F.col("mean"))
        .select(
            *keys,
            "row",
            "col",
            F.when(F.col("std") > 0, F.col("d") / (F.col("std") / F.sqrt("n")))
            .when((F.col("std") == 0) & (F.col("d") > 0), F.lit(float("inf")))
            .when((F.col("std") == 0) & (F.col("d") < 0), F.lit(float("-inf")))
            .alias("t"),
        )
    )
    return scored if clip is None else quantile_clip(scored, "t", *clip, keys=keys, exact=exact)


#: Share of the rows by which approximate quantiles may miss their rank.
_RANK_ERROR = 1e-3


def _kept(df: DataFrame, kept: bool) -> DataFrame:
    """``df`` written once, unless it lies in files already: what reads it again doesn't work it out again."""
    return df if kept else cut(df)


def quantiles(df: DataFrame, value: str, lo: float, hi: float, keys: tuple[str, ...] = (), exact: bool = True, kept: bool = False) -> DataFrame:
    """keys, q_lo, q_hi with linear interpolation (``exact``), or approximate.

    Exact ones take two passes: approximate quantiles on both sides of each wanted rank, then the
    counts of the values between these, a few thousandths of all rows, so that no task holds every
    value of an image. The values at the two ranks are found by running sums of those counts.
    Values are written before the passes, unless they are ``kept`` already.
    """
    if not exact:
        q = F.percentile_approx(value, [lo, hi], 100_000)
        return df.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("q_lo"), F.col("q")[1].alias("q_hi"))
    sides = [max(0.0, lo - 2 * _RANK_ERROR), min(1.0, lo + 2 * _RANK_ERROR), max(0.0, hi - 2 * _RANK_ERROR), min(1.0, hi + 2 * _RANK_ERROR)]
    slim = _kept(df.select(*keys, F.col(value).cast("double").alias("_v")), kept)
    near = F.percentile_approx("_v", sides, int(1 / _RANK_ERROR))
    ends = cut(slim.groupBy(*keys).agg(F.count("_v").alias("_n"), near.alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max")))
    few = F.col("_n") * _RANK_ERROR < 10  # so few that the sides could be nearer than a rank: all values are counted
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("which"),
                ((F.col("_n") - 1) * F.lit(q)).alias("rank"),
                F.when(few | F.lit(sides[2 * i] == 0), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("from"),
                F.when(few | F.lit(sides[2 * i + 1] == 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("to"),
            )
            for i, q in enumerate((lo, hi))
        ]
    )
    spans = ends.where("_n > 0").select(*keys, F.explode(wanted).alias("w"))
    # two rows per key: one value each side
    joined = with_key_rows(slim.where("_v is not null"), spans, keys)
    at = F.when(F.col("_v") < F.col("w.from"), F.lit(None)).otherwise(F.col("_v"))
    counts = joined.where(F.col("_v") <= F.col("w.to")).groupBy(*keys, F.col("w.which").alias("which"), at.alias("at")).agg(F.count("*").alias("n"), F.first("w.rank").alias("rank"))
    up = Window.partitionBy(*keys, "which").orderBy(F.col("at").asc_nulls_first())
    upto = counts.withColumn("upto", F.sum("n").over(up))
    value_at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("at")))
    found = upto.groupBy(*keys, "which").agg(F.first("rank").alias("rank"), value_at(F.floor("rank")).alias("low"), value_at(F.ceil("rank")).alias("high"))
    part = F.col("rank") - F.floor("rank")
    q = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("rank") - F.col("rank")) * F.col("low") + part * F.col("high"))
    by_key = found.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, q)).alias("q_lo"), F.max(F.when(F.col("which") == 1, q)).alias("q_hi"))
    # keys without values keep a row
    return ends.select(*keys).join(by_key, list(keys), "left") if keys else by_key


def _with_quantiles(df: DataFrame, value: str, lo: float, hi: float, keys: tuple[str, ...], exact: bool, kept: bool) -> DataFrame:
    df = _kept(df, kept)
    own = df.select(*keys, F.col(value).cast("double").alias("_v"))
    q = cut(quantiles(own, "_v", lo, hi, keys, exact, kept=True))
    return with_key_rows(df, q, keys, "left")


def quantile_clip(df: DataFrame, value: str, lo: float, hi: float, keys: tuple[str, ...] = (), exact: bool = True, kept: bool = False) -> DataFrame:
    """Values outside the two quantiles become the quantile."""
    clipped = F.when(F.col(value).isNotNull(), F.greatest("q_lo", F.least("q_hi", value)))
    return _with_quantiles(df, value, lo, hi, keys, exact, kept).withColumn(value, clipped).drop("q_lo", "q_hi")


def quantile_trim(df: DataFrame, value: str, lo: float, hi: float, keys: tuple[str, ...] = (), exact: bool = True, kept: bool = False) -> DataFrame:
    """Rows strictly outside the two quantiles go."""
    return _with_quantiles(df, value, lo, hi, keys, exact, kept).where((F.col(value) >= F.col("q_lo")) & (F.col(value) <= F.col("q_hi"))).drop("q_lo", "q_hi")


def histogram(df: DataFrame, value: str, bins: int, keys: tuple[str, ...] = (), kept: bool = False) -> DataFrame:
    """keys, bin, n, lo, hi: equal bins between least and greatest value, the last one closed."""
    df = _kept(df.select(*keys, value), kept)
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    with_ends = with_key_rows(df, ends, keys)
    width = F.col("hi") - F.col("lo")
    place = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / F.when(width != 0, width))))
    return with_ends.where(F.col(value).isNotNull()).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def otsu_threshold(df: DataFrame, value: str, keys: tuple[str, ...] = (), bins: int = 256, kept: bool = False) -> DataFrame:
    """keys, threshold: centre of the first bin with the greatest between-class variance.

    The cumulative sums run over at most ``bins`` rows per key. A constant input gives its value.
    """
    h = histogram(df, value, bins, keys, kept).withColumn("x", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    full = (
        h.groupBy(*keys)
        .agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("at"))
        .select(*keys, "lo", "hi", "at", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .withColumn("n", F.coalesce(F.try_element_at("at", F.col("bin")), F.lit(0)))
        .withColumn("x", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    )
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    w1, w2 = F.sum("n").over(up), F.sum("n").over(down)
    m1, m2 = F.sum(F.col("n") * F.col("x")).over(up), F.sum(F.col("n") * F.col("x")).over(down)
    scored = full.withColumns({"w1": w1, "w2": w2, "s1": m1, "s2": m2}).withColumn(
        "var", F.when((F.col("w1") > 0) & (F.col("w2") > 0), F.col("w1") * F.col("w2") * F.pow(F.col("s1") / F.nullif("w1", F.lit(0)) - F.col("s2") / F.nullif("w2", F.lit(0)), F.lit(2.0)))
    )
    # differences far below what doubles can tell are ties, and the first bin wins them
    best = F.max_by("x", F.struct(F.round("var", 9), -F.col("bin")))
    return scored.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), best.alias("best")).select(
        *keys, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("best")).alias("threshold")
    )


def kittler_threshold(df: DataFrame, value: str, keys: tuple[str, ...] = (), kept: bool = False) -> DataFrame:
    """keys, threshold: minimum-error threshold on tenths of whole steps between two percentiles.

    Bins run over [lo, hi], the 0.1 and 99.9 percentiles truncated to whole numbers, ten per
    whole number in it; values outside are ignored. lo = hi gives NULL.
    """
    df = _kept(df.select(*keys, F.col(value).cast("double").alias(value)), kept)
    ends = cut(quantiles(df, value, 0.001, 0.999, keys, kept=True).select(*keys, F.col("q_lo").cast("long").alias("lo"), F.col("q_hi").cast("long").alias("hi")))
    joined = with_key_rows(df, ends, keys)
    bins = (F.col("hi") - F.col("lo") + 1) * 10
    width = F.col("hi") - F.col("lo")
    place = F.least(bins - 1, F.floor((F.col(value) - F.col("lo")) * bins / F.when(width > 0, width)))
    h = (
        joined.where((F.col("hi") > F.col("lo")) & F.col(value).between(F.col("lo"), F.col("hi")))
        .groupBy(*keys, place.alias("bin"))
        .agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        .withColumn("g", F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / ((F.col("hi") - F.col("lo") + 1) * 10.0))
    )
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    n, g = F.col("n").cast("double"), F.col("g")
    sums = h.withColumns({"c": F.sum(n).over(up), "m": F.sum(n * g).over(up), "s": F.sum(n * g * g).over(up), "all_c": F.sum(n).over(everything), "all_m": F.sum(n * g).over(everything), "all_s": F.sum(n * g * g).over(everything)})

    def deviation(c: Column, m: Column, s: Column) -> Column:
        var = F.try_divide(s, c) - F.pow(F.try_divide(m, c), F.lit(2.0))
        return F.when(var > 1e-12, F.sqrt(var))

    c, total = F.col("c"), F.col("all_c")
    front = deviation(c, F.col("m"), F.col("s"))
    back = deviation(total - c, F.col("all_m") - F.col("m"), F.col("all_s") - F.col("s"))
    p = c / total
    v = p * F.ln(front) + (1 - p) * F.ln(back) - p * F.ln(p) - (1 - p) * F.ln(F.when(p < 1, 1 - p))
    scored = sums.withColumn("v", v)
    found = scored.where("v is not null").groupBy(*keys).agg(F.min_by("g", F.struct(F.round("v", 9), "bin")).alias("threshold"))
    return ends.select(*keys).join(found, list(keys), "left") if keys else found.select("threshold").unionByName(
        ends.where("hi <= lo").select(F.lit(None).cast("double").alias("threshold"))
    )


def bimodality_coefficient(df: DataFrame, value: str, keys: tuple[str, ...] = (), least: int = 100) -> DataFrame:
    """keys, n, bc: (skewness^2 + 1) / (kurtosis + 3 (n-1)^2 / ((n-2)(n-3))), NULL below ``least``."""
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k"))
    n = F.col("n").cast("double")
    bc = F.try_divide(F.col("s") * F.col("s") + 1, F.col("k") + F.try_divide(3 * (n - 1) * (n - 1), (n - 2) * (n - 3)))
    return sums.select(*keys, "n", F.when(F.col("n") >= least, bc).alias("bc"))


def water_stats(scores: DataFrame, mask: str = "mask", lo: float = 0.01, hi: float = 0.99, keys: tuple[str, ...] = (), kept: bool = False) -> DataFrame:
    """keys, mean, std of clipped scores with pixels outside the mask as 0 (not missing)."""
    raw = scores.select(*keys, F.when(F.col("t").isNotNull(), F.when(F.col(mask), F.col("t")).otherwise(0.0)).alias("t"))
    clipped = quantile_clip(raw, "t", lo, hi, keys, kept=kept)
    return clipped.groupBy(*keys).agg(F.avg("t").alias("mean"), F.stddev_pop("t").alias("std"))


def histogram_compare(scores: DataFrame, flag: str, bins: int = 100, lo: float = 0.005, hi: float = 0.995, keys: tuple[str, ...] = (), kept: bool = False) -> DataFrame:
    """keys, source (all, flagged), bin, n: counts of trimmed scores, each source over its own range."""
    sources = F.array(F.lit("all"), F.when(F.col(flag), F.lit("flagged")))
    both = scores.where("t is not null").select(*keys, "t", F.explode(F.filter(sources, lambda s: s.isNotNull())).alias("source"))
    by = (*keys, "source")
    return histogram(quantile_trim(both, "t", lo, hi, by, kept=kept), "t", bins, by, kept=True).select(*by, "bin", "n")


def display_stretch(df: DataFrame, value: str, lo: float = 0.01, hi: float = 0.99, keys: tuple[str, ...] = (), kept: bool = False) -> DataFrame:
    """A band clipped to two quantiles of its finite values."""
    finite = df.withColumn(value, F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value)))
    return quantile_clip(finite, value, lo, hi, keys, kept=kept)
