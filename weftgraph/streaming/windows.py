"""Windows over change streams: quiet periods, trailing rates, tumbling counts. All take batch or streaming DataFrames unless said."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bursts(events: DataFrame, key: str, ts: str, quiet: str = "750 milliseconds", late: str = "10 minutes") -> DataFrame:
    """One row for each run of changes of a key that no quiet period parts: (key, started, fires, changes)."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.session_window(F.col(ts), quiet)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("changes")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "changes")


def tumbling(events: DataFrame, ts: str, width: str, *by: str, late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def trailing_rate(samples: DataFrame, key: str, ts: str, value: str, seconds: int = 60, most: int = 64) -> DataFrame:
    """Batch: sum of value over the last ``seconds`` and at most ``most`` samples of the key, divided by seconds."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    n = F.count("*").over(w)
    recent = Window.partitionBy(key).orderBy(F.unix_micros(ts), "event_id").rowsBetween(-(most - 1), 0)
    total = F.when(n <= most, F.sum(value).over(w)).otherwise(F.sum(value).over(recent))
    return samples.withColumn("samples", F.least(n, F.lit(most))).withColumn("rate", total / seconds)


def polling_speed(samples: DataFrame, key: str, ts: str, indexed: str) -> DataFrame:
    """Batch: growth a second since the sample before, never below 0; null for the first sample."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    dt = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1e6
    return samples.withColumn("speed", F.greatest(F.lit(0.0), (F.col(indexed) - F.lag(indexed).over(w)) / F.nullif(dt, F.lit(0.0))))
