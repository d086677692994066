"""Records per scheme and hour, as a batch or a stream with late rows. An extension: there is no counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(records: DataFrame, late: str | None = None) -> DataFrame:
    """``late``: how long a stream waits for late rows, like "10 minutes"; a batch needs none."""
    rows = records.withWatermark("ts", late) if late else records
    return rows.groupBy("scheme", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("scheme", F.col("w.start").alias("hour"), "n")
