"""Means and counts of strata over a stream: the part of aggregation that can be kept incrementally.

An exact median can't be kept in bounded state, so it isn't offered here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.functions.exprs import col, number
from phenolith.functions.schema import features_of


def aggregate_stream(df: DataFrame, strata: Sequence[str], features: str | Sequence[str] = "infer", event_time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A streaming DataFrame of means and object counts by stratum, and by window of event time on demand."""
    features = [c for c in features_of(df, features) if c not in strata]
    keys = [col(k) for k in strata]
    if event_time is not None:
        df = df.withWatermark(event_time, late)
        if window is not None:
            keys.append(F.window(col(event_time), window).alias("window"))
    return df.groupBy(*keys).agg(F.count("*").alias("Metadata_Object_Count"), *[F.avg(number(c)).alias(c) for c in features])
