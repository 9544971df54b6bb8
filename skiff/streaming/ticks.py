"""Tick volumes by second as a stream: late ticks up to a bound, one row for each symbol and second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def volume_by_second(ticks: DataFrame, symbol: str, time: str, volume: str, late: str = "10 seconds") -> DataFrame:
    """A streaming or batch DataFrame of (symbol, second, v); state older than the watermark is dropped."""
    timed = ticks.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.col(symbol).alias("symbol"), F.window("_t", "1 second").alias("w")).agg(F.sum(volume).alias("v"))
    return out.select("symbol", F.col("w.start").alias("second"), "v")
