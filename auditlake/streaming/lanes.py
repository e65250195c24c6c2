"""The batch lanes over a stream of delivered files (an extension; the batch results are the reference point)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect


def late_deduplicated(files: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each file once, though deliveries repeat and come late: state is kept for ``delay`` of event time."""
    return files.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["artifact_id"])


def stream_findings(files: DataFrame, rules: list[detect.Rule] = detect.RULES) -> DataFrame:
    """Line findings of a stream of files; stateless, so files need no order."""
    return detect.hit_lines(files.select("ingested_at", "pkg_id", F.col("rel").alias("path"), "kind", "text"), rules).drop("kind")


def windowed_counts(findings: DataFrame, size: str = "1 day", delay: str = "30 days") -> DataFrame:
    """Findings by vector and window of delivery time, final once the watermark has passed."""
    return findings.withWatermark("ingested_at", delay).groupBy(F.window("ingested_at", size), "vector").agg(F.count("*").alias("n"))
