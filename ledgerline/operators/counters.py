"""Run counters that are filled while a frame is computed, without a pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str = "rows", **conditions: Column) -> tuple[DataFrame, Observation]:
    """df that counts its rows, and those that meet each condition, when an action runs.

    Read the counts with `.get` of the observation after the action.
    """
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias(name), *(F.count_if(c).alias(n) for n, c in conditions.items())]
    return df.observe(seen, *metrics), seen
