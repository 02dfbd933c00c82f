"""Local thresholds in windows around seeds, with twins that write out every rule per window.

The twins take windows without smoothing. They hold the choice of a window by its bimodality, both
threshold methods, the comparisons with the water statistics, and Kolmogorov-Smirnov tests: the
asymptotic series, and lattice paths where it is near the cut-off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.operators import delineate
from inundata.plans import views as v
from inundata.plans.registry import register

#: A mask whose limit changes from area to area, so that windows come to every decision.
LIMIT = "-0.5e0 - 0.6e0 * (row // 24 % 3)"

CELLS = f"""{v.BAND}, ends AS (SELECT max(row) + 1 AS rows, max(col) + 1 AS cols FROM band), marked AS (SELECT row, col, t, t < {LIMIT} AS m FROM band),
  w AS (SELECT row AS sr, col AS sc, half, greatest(0, row - half) AS a, least(rows, row + half + 1) AS b, greatest(0, col - half) AS d, least(cols, col + half + 1) AS e
    FROM marked, ends, (SELECT unnest([4, 6]) AS half) WHERE m AND row % 12 = 0 AND col % 12 = 0),
  cells AS (SELECT x.*, t, coalesce(m, false) AS m FROM (SELECT sr, sc, half, row, unnest(range(d, e)) AS col FROM (SELECT *, unnest(range(a, b)) AS row FROM w)) x
    LEFT JOIN marked ON x.row = marked.row AND x.col = marked.col),
  mean AS (SELECT sr, sc, half, avg(t) AS mu FROM cells GROUP BY 1, 2, 3),
  mo AS (SELECT c.sr, c.sc, c.half, count(t) AS n, avg(pow(t - mu, 2)) AS m2, avg(pow(t - mu, 3)) AS m3, avg(pow(t - mu, 4)) AS m4 FROM cells c JOIN mean USING (sr, sc, half) GROUP BY 1, 2, 3),
  bc AS (SELECT sr, sc, half, CASE WHEN n >= 60 AND m2 > 0 THEN (pow(m3 / pow(m2, 1.5e0), 2) + 1) / (m4 / (m2 * m2) - 3 + 3e0 * (n - 1) * (n - 1) / ((n - 2e0) * (n - 3e0))) ELSE 0e0 END AS bc FROM mo),
  pick AS (SELECT sr, sc, bc, CASE WHEN bc > BIMODAL THEN half ELSE 6 END AS half FROM bc QUALIFY row_number() OVER (PARTITION BY sr, sc ORDER BY bc DESC, half) = 1),
  k AS (SELECT c.sr, c.sc, c.row, c.col, c.t, c.m, bc > BIMODAL AS bimodal FROM cells c JOIN pick USING (sr, sc, half))"""

#: Classes split after a bin that holds values; empty bins split as the last one before them that does.
OTSU = """he AS (SELECT sr, sc, min(t) AS lo, max(t) AS hi FROM k GROUP BY 1, 2),
  hb AS (SELECT sr, sc, least(255, CAST(floor((t - lo) * 256 / (hi - lo)) AS INT)) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*)::DOUBLE AS n FROM k JOIN he USING (sr, sc) WHERE t IS NOT NULL AND hi > lo GROUP BY 1, 2, 3),
  hx AS (SELECT sr, sc, bin, n, lo + (bin + 0.5e0) * (hi - lo) / 256 AS x FROM hb),
  hs AS (SELECT sr, sc, bin, x, sum(n) OVER a AS w1, sum(n * x) OVER a AS s1, sum(n) OVER b AS wn, sum(n * x) OVER b AS sn FROM hx WINDOW a AS (PARTITION BY sr, sc ORDER BY bin ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY sr, sc)),
  th AS (SELECT sr, sc, x AS th FROM hs WHERE wn > w1 QUALIFY row_number() OVER (PARTITION BY sr, sc ORDER BY round(w1 * (wn - w1) * pow(s1 / w1 - (sn - s1) / (wn - w1), 2), 6) DESC, bin) = 1)"""

KITTLER = """he AS (SELECT sr, sc, CAST(trunc(quantile_cont(t, 0.001)) AS BIGINT) AS lo, CAST(trunc(quantile_cont(t, 0.999)) AS BIGINT) AS hi FROM k GROUP BY 1, 2),
  hb AS (SELECT sr, sc, least((hi - lo + 1) * 10 - 1, CAST(floor((t - lo) * ((hi - lo + 1) * 10) / (hi - lo)) AS BIGINT)) AS bin, count(*)::DOUBLE AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM k JOIN he USING (sr, sc) WHERE hi > lo AND t BETWEEN lo AND hi GROUP BY 1, 2, 3),
  hx AS (SELECT sr, sc, bin, n, lo + bin * (hi - lo) / ((hi - lo + 1) * 10e0) AS x FROM hb),
  hs AS (SELECT sr, sc, bin, x, sum(n) OVER a AS c, sum(n * x) OVER a AS m, sum(n * x * x) OVER a AS s, sum(n) OVER b AS cc, sum(n * x) OVER b AS mm, sum(n * x * x) OVER b AS ss FROM hx WINDOW a AS (PARTITION BY sr, sc ORDER BY bin ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY sr, sc)),
  hv AS (SELECT sr, sc, bin, x, c / cc AS p, s / c - pow(m / c, 2) AS vf, (ss - s) / (cc - c) - pow((mm - m) / (cc - c), 2) AS vb FROM hs WHERE cc > c),
  th AS (SELECT sr, sc, x AS th FROM hv WHERE vf > 1e-12 AND vb > 1e-12 QUALIFY row_number() OVER (PARTITION BY sr, sc ORDER BY round(p * ln(vf) / 2 + (1 - p) * ln(vb) / 2 - p * ln(p) - (1 - p) * ln(1 - p), 9), bin) = 1)"""

DECIDED = """c AS (SELECT k.*, coalesce(t < th, false) AS low, coalesce(t >= th, false) AS high FROM k LEFT JOIN th USING (sr, sc)),
  s AS (SELECT sr, sc, any_value(bimodal) AS bimodal, count(t) AS valid, count(*) FILTER (WHERE m) AS masked, bool_or(low) AND bool_or(high) AND bool_or(m) AND NOT bool_and(m) AS split,
    stddev_pop(t) FILTER (WHERE low) AS ws, median(t) FILTER (WHERE low) AS wm, stddev_pop(t) FILTER (WHERE high) AS ls, median(t) FILTER (WHERE high) AS lm FROM c GROUP BY 1, 2),
  open AS (SELECT sr, sc FROM s WHERE bimodal AND split),
  pts AS (SELECT sr, sc, 'water' AS kind, t AS x, low::INT AS a, m::INT AS b FROM c JOIN open USING (sr, sc) WHERE low OR m
    UNION ALL SELECT sr, sc, 'land', coalesce(t, 'infinity'::DOUBLE), high::INT, (NOT m)::INT FROM c JOIN open USING (sr, sc) WHERE high OR NOT m),
  met AS (SELECT sr, sc, kind, x, sum(a) AS a, sum(b) AS b FROM pts GROUP BY 1, 2, 3, 4),
  run AS (SELECT sr, sc, kind, sum(a) OVER u AS ra, sum(b) OVER u AS rb, sum(a) OVER o AS n, sum(b) OVER o AS m FROM met WINDOW u AS (PARTITION BY sr, sc, kind ORDER BY x ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY sr, sc, kind)),
  ks AS (SELECT sr, sc, kind, any_value(n)::BIGINT AS n, any_value(m)::BIGINT AS m, max(abs(ra::DOUBLE / n - rb::DOUBLE / m)) AS d FROM run GROUP BY 1, 2, 3),
  near AS (SELECT *, greatest(0e0, least(1e0, 2 * list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * i * i * d * d * n * m / (n + m)))))) AS series FROM ks),
  paths(sr, sc, kind, n, m, d, i, line) AS (SELECT sr, sc, kind, n, m, d, 0, list_transform(range(m + 1), lambda j: CASE WHEN j * n < d * n * m - 0.5 THEN 1e0 ELSE 0e0 END) FROM near WHERE d > 0 AND series > CUT / 4 AND series < CUT * 4
    UNION ALL SELECT sr, sc, kind, n, m, d, i + 1, list_transform(range(m + 1), lambda j: CASE WHEN abs((i + 1) * m - j * n) < d * n * m - 0.5 THEN
      list_sum(list_transform(range(j + 1), lambda h: CASE WHEN abs((i + 1) * m - h * n) < d * n * m - 0.5 THEN line[h + 1] ELSE 0e0 END)) ELSE 0e0 END) FROM paths WHERE i < n),
  exact AS (SELECT sr, sc, kind, 1 - line[m + 1] / exp(lgamma(n + m + 1) - lgamma(n + 1) - lgamma(m + 1)) AS p FROM paths WHERE i = n),
  same AS (SELECT sr, sc, bool_or(kind = 'water' AND ok) AS water, bool_or(kind = 'land' AND ok) AS land FROM (SELECT sr, sc, kind, d = 0 OR coalesce(p, series) >= CUT AS ok FROM near LEFT JOIN exact USING (sr, sc, kind)) GROUP BY 1, 2),
  says AS (SELECT sr, sc, CASE WHEN NOT bimodal THEN CASE WHEN valid > 0 THEN 'mask' ELSE 'none' END WHEN NOT split THEN 'mask'
      WHEN NOT (water OR (pow(WATER - ws, 2) / (SPREAD * SPREAD + ws * ws) > 5 AND wm <= WATER)) THEN 'none'
      WHEN ((pow(WATER - ls, 2) / (SPREAD * SPREAD + ls * ls) > 5 AND lm >= WATER) OR land) AND 100e0 * masked / valid > 10 THEN 'low' ELSE 'mask' END AS say
    FROM s LEFT JOIN same USING (sr, sc)),
  v AS (SELECT row, col, count(*) FILTER (WHERE say = 'mask' AND m OR say = 'low' AND low) AS votes, count(*) AS visits FROM c JOIN says USING (sr, sc) GROUP BY 1, 2)
  SELECT band.row, band.col, round(coalesce(votes / (visits + 1e0), 0e0), 6) AS probability, coalesce(votes / (visits + 1e0), 0e0) > 0.25e0 AS flooded FROM band LEFT JOIN v ON band.row = v.row AND band.col = v.col"""


def _twin(threshold: str, bimodal: float, water: float, spread: float, cut: float) -> str:
    text = f"WITH RECURSIVE {CELLS}, {threshold}, {DECIDED}"
    for name, value in (("BIMODAL", bimodal), ("WATER", water), ("SPREAD", spread), ("CUT", cut)):
        text = text.replace(name, f"({value!r}::DOUBLE)")
    return text


def _voted(spark: SparkSession, sf: str, method: str, bimodal: float, water: float, spread: float, cut: float) -> DataFrame:
    b = v.band(spark, sf)
    mask = b.withColumn("mask", F.col("t") < -0.5 - 0.6 * (F.floor(F.col("row") / 24) % 3))
    p = delineate.FloodParams(halves=(4, 6), local_bimodality=bimodal, local_smoothing=False, unit_m2=14400, least_pixels=60, method=method, ks_p=cut, tile=64)
    return delineate.adaptive_threshold(b, mask, water, spread, p).select("row", "col", F.round("probability", 6).alias("probability"), "flooded")


@register(_twin(OTSU, 0.53, -1.4, 0.1, 0.001))
def local_otsu(spark: SparkSession, sf: str) -> DataFrame:
    """Windows without smoothing, thresholds by class variances."""
    return _voted(spark, sf, "otsu", 0.53, -1.4, 0.1, 0.001)


@register(_twin(KITTLER, 0.5, -1.5, 0.2, 0.01))
def local_kittler(spark: SparkSession, sf: str) -> DataFrame:
    """Windows without smoothing, thresholds of least error."""
    return _voted(spark, sf, "kittler", 0.5, -1.5, 0.2, 0.01)
