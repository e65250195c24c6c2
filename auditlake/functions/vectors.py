"""The vector registry: id, tier and weakness classes of each kind of finding, and the severity order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tier and CWE tags by vector.
VECTORS = [
    ("SXV-001", "T2", "CWE-94,CWE-829"), ("SXV-002", "T2", "CWE-94,CWE-829"), ("SXV-003", "T3", "CWE-829,CWE-732"), ("SXV-004", "T3", "CWE-732"),
    ("SXV-005", "T2", "CWE-829,CWE-94"), ("SXV-006", "T2", "CWE-829,CWE-94"), ("SXV-007", "T2", "CWE-451"), ("SXV-008", "T1", "CWE-78,CWE-77"),
    ("SXV-009", "T2", "CWE-494,CWE-829"), ("SXV-010", "T2", "CWE-494,CWE-829"), ("SXV-011", "T2", "CWE-522,CWE-200"), ("SXV-012", "T3", "CWE-829"),
    ("SXV-013", "T3", "CWE-1395,CWE-494"), ("SXV-014", "T1", "CWE-1007,CWE-94"), ("SXV-015", "T1", "CWE-1007,CWE-829"), ("SXV-016", "T3", "CWE-1395,CWE-937"),
    ("SXV-017", "T1", "CWE-798,CWE-540"), ("SXV-018", "T2", "CWE-494,CWE-829"), ("SXV-019", "T2", "CWE-506"), ("SXV-020", "T2", "CWE-829"),
    ("SXV-021", "T2", "CWE-918,CWE-522"), ("SXV-022", "T2", "CWE-250"), ("SXV-023", "T2", "CWE-522,CWE-538"), ("SXV-024", "T3", "CWE-200"),
    ("SXV-025", "T2", "CWE-200,CWE-538"), ("SXV-026", "T3", "CWE-526,CWE-200"), ("SXV-027", "T2", "CWE-506"), ("SXV-028", "T2", "CWE-77,CWE-1427"),
    ("SXV-029", "T3", "CWE-1427"), ("SXV-030", "T3", "CWE-1427"), ("SXV-031", "T2", "CWE-1427"), ("SXV-032", "T2", "CWE-200,CWE-497"),
    ("SXV-033", "T3", "CWE-280,CWE-863"), ("SXV-034", "T2", "CWE-502,CWE-94"), ("SXV-035", "T2", "CWE-646,CWE-506"), ("SXV-036", "T2", "CWE-506,CWE-838"),
    ("SXV-037", "T2", "CWE-506"), ("SXV-038", "T2", "CWE-1427,CWE-200"), ("SXV-039", "T2", "CWE-506,CWE-829"), ("SXV-040", "T1", "CWE-506,CWE-912"),
    ("SXV-041", "T2", "CWE-829,CWE-1427"), ("SXV-042", "T2", "CWE-506,CWE-912,CWE-1427"), ("SXV-043", "T1", "CWE-200,CWE-359,CWE-1427"), ("SXV-044", "T2", "CWE-506,CWE-912"),
]
SEVERITIES = ("critical", "high", "medium", "low")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VECTORS, "vector string, tier string, cwe string")


def severity_rank(severity: str | Column = "severity") -> Column:
    """0 for critical to 3 for low, 9 for anything else."""
    c = F.col(severity) if isinstance(severity, str) else severity
    out = F.when(c == SEVERITIES[0], 0)
    for k, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(c == s, k)
    return out.otherwise(9)
