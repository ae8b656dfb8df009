"""Extension: diagnostics counted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import severity_bucket
from graphloom.operators.callgraph import SEVERITIES


def windowed_diagnostics(stream: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of each severity by unit and window of ``ts``; rows later than ``late`` are left out. State is one row for each
    open window and unit."""
    bucket = severity_bucket(F.col("severity"))
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "translation_unit")
    return counted.agg(*(F.count_if(bucket == s).alias(f"diagnostic_{s}_count") for s in SEVERITIES), F.count(F.lit(1)).alias("total_diagnostic_count"))
