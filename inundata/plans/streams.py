"""Registered queries of the streaming twins, run over the events as a file stream until it ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.plans import views as v
from inundata.plans.registry import register
from inundata.sources.folders import fresh
from inundata.streaming.rain import stream_new_products, stream_rain_daily, stream_thin_datetimes


def _stream(spark: SparkSession, sf: str, frame: DataFrame) -> DataFrame:
    """A file stream of the rows of ``frame``; all files make one trigger, as their order is not known."""
    path = fresh(spark, "stream")
    frame.write.parquet(path)
    return spark.readStream.schema(frame.schema).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that a stream appends, once its input ends."""
    out = fresh(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh(spark, f"{name}-log")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _ending(frame: DataFrame, columns: dict) -> DataFrame:
    """``frame`` and one row far in the future, which moves the watermark past everything before."""
    last = frame.agg(F.max("ts").alias("t")).select(*[(columns[c] if c in columns else F.lit(None).cast(dict(frame.dtypes)[c])).alias(c) for c in frame.columns])
    return frame.unionByName(last)


@register("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, round(sum(greatest(0e0, value)), 3) AS tp_mm FROM events GROUP BY 1")
def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    hours = v.events(spark, sf).select("ts", F.col("value").alias("tp_mm"))
    fed = _ending(hours, {"ts": F.col("t") + F.expr("INTERVAL 400 DAYS"), "tp_mm": F.lit(0.0)})
    days = drained(spark, stream_rain_daily(_stream(spark, sf, fed)), "daily")
    return days.where(F.col("day") < F.lit("2025-01-01").cast("timestamp")).select("day", F.round("tp_mm", 3).alias("tp_mm"))


@register("SELECT event_type, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS begin, max(ts) AS published, arg_max(event_id, (epoch_us(ts), -event_id)) AS id FROM events GROUP BY 1, 2")
def stream_products(spark: SparkSession, sf: str) -> DataFrame:
    """The newest product of each minute and kind, from a stream in which older ones may come later."""
    p = v.events(spark, sf).select("event_type", F.date_trunc("minute", "ts").alias("begin"), F.col("ts").alias("published"), F.col("event_id").alias("id"))
    ends = p.agg(F.max("begin").alias("t")).select(F.lit(None).cast("string").alias("event_type"), (F.col("t") + F.expr("INTERVAL 400 DAYS")).alias("begin"), F.col("t").alias("published"), F.lit(-1).cast("long").alias("id"))
    newest = stream_new_products(_stream(spark, sf, p.unionByName(ends)), keys=("event_type",))
    return drained(spark, newest, "products").where("id >= 0")


@register("""WITH RECURSIVE n AS (SELECT k, ts, row_number() OVER (PARTITION BY k ORDER BY ts) AS i FROM (SELECT DISTINCT user_id % 20 AS k, ts FROM events)),
  w AS (SELECT k, ts, i, ts AS last, true AS keep FROM n WHERE i = 1 UNION ALL
    SELECT n.k, n.ts, n.i, CASE WHEN n.ts - w.last >= INTERVAL 6 HOURS THEN n.ts ELSE w.last END, n.ts - w.last >= INTERVAL 6 HOURS FROM w JOIN n ON n.k = w.k AND n.i = w.i + 1)
  SELECT k AS key, ts FROM w WHERE keep""")
def stream_thin(spark: SparkSession, sf: str) -> DataFrame:
    times = v.events(spark, sf).select((F.col("user_id") % 20).alias("key"), "ts")
    fed = _ending(times, {"ts": F.col("t") + F.expr("INTERVAL 400 DAYS"), "key": F.lit(-1).cast("long")})
    return drained(spark, stream_thin_datetimes(_stream(spark, sf, fed), seconds=6 * 3600.0), "thin").where("key >= 0")
