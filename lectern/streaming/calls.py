"""Call statistics over a stream of call logs: windows by event time, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X


def windowed_stats(calls: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Works on a stream and on a table alike. calls: (ts, provider, model, status, latency_seconds, tokens)."""
    good = (F.col("status") == "success") & (F.col("latency_seconds") > 0)
    return (
        calls.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window), "provider", "model")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), X.exact_mean(F.when(good, F.col("latency_seconds"))).alias("avg_latency"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "provider", "model", "calls", "tokens", "avg_latency")
    )
