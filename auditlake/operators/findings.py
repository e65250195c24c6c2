"""Findings: enrichment, order, de-duplication, caps, occurrence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import registry, severity_rank

#: Findings kept of one group before the rest become one note.
CAP = 25
COLUMNS = ("pkg_id", "path", "vector", "rule", "severity", "message", "line_no", "col_no")


def order_columns() -> list[Column]:
    """Severity, path, vector, position (missing as -1), rule, message."""
    return [severity_rank(), F.col("path"), F.col("vector"), F.coalesce("line_no", F.lit(-1)), F.coalesce("col_no", F.lit(-1)), F.col("rule"), F.col("message")]


def enrich(findings: DataFrame) -> DataFrame:
    """Tier and weakness classes by vector; findings without a vector keep null there. The registry is 44 rows."""
    return findings.join(F.broadcast(registry(findings.sparkSession)), "vector", "left")


def dedupe(findings: DataFrame) -> DataFrame:
    """One row of those equal but for severity: the most severe."""
    key = ["pkg_id", "vector", "path", "rule", "message", "line_no", "col_no"]
    return findings.groupBy(*key).agg(F.min_by("severity", severity_rank()).alias("severity")).select(*COLUMNS)


def group_key(variant: str = "") -> Column:
    """What makes a group under the cap: the vector, or the rule where there is none.

    Understated permissions are split by capability, but for the ``instruction``
    variant; ``obfuscation`` also splits by rule and severity.
    """
    key = F.coalesce(F.nullif("vector", F.lit("")), "rule")
    if variant == "obfuscation":
        return F.concat_ws(" ", key, "rule", "severity")
    if variant == "instruction":
        return key
    axis = F.when(F.col("rule").contains("network"), "network").otherwise("execution")
    return F.when(F.col("vector") == "SXV-033", F.concat_ws(" ", key, axis)).otherwise(key)


def cap(findings: DataFrame, most: int = CAP, slices: int = 32, variant: str = "") -> DataFrame:
    """First ``most`` findings of each (path, ``group_key``), and one low ``findings-capped`` row with the overflow of each group.

    The order puts the reported severity first, so a fixture that counts less never takes the place of a live finding.

    Ranking and counting happen in hashed slices of a group first, so no task
    ranks a whole hot group: the first ``most`` of a group are among the first
    ``most`` of its slices, and the group's size is the sum of its slices'.
    """
    group = ["pkg_id", "path", "group_key"]
    keyed = findings.withColumn("group_key", group_key(variant)).withColumn("_slice", F.pmod(F.xxhash64("line_no", "col_no", "message"), F.lit(slices)))
    part = Window.partitionBy(*group, "_slice")
    first = keyed.withColumn("_r", F.row_number().over(part.orderBy(*order_columns()))).withColumn("_n", F.count("*").over(part)).where(F.col("_r") <= most)
    whole = Window.partitionBy(*group)
    kept = (
        first.withColumn("_total", F.sum(F.when(F.col("_r") == 1, F.col("_n"))).over(whole))
        .withColumn("_r", F.row_number().over(whole.orderBy(*order_columns())))
        .where(F.col("_r") <= most)
    )
    own = F.struct("vector", "rule", "severity", "message", "line_no", "col_no")
    none = F.lit(None).cast("int")
    note = F.struct(F.lit("").alias("vector"), F.lit("findings-capped").alias("rule"), F.lit("low").alias("severity"), F.concat(F.col("group_key"), F.lit(": "), (F.col("_total") - most).cast("string"), F.lit(" more")).alias("message"), none.alias("line_no"), none.alias("col_no"))
    both = F.when((F.col("_r") == 1) & (F.col("_total") > most), F.array(own, note)).otherwise(F.array(own))
    return kept.select("pkg_id", "path", F.explode(both).alias("f")).select("pkg_id", "path", "f.*").select(*COLUMNS)


def occurrences(findings: DataFrame) -> DataFrame:
    """Fingerprint of what a finding says without its line, numbered among equals by position: stable when lines move."""
    base = F.sha2(F.concat_ws("\x1f", "vector", "rule", "severity", "path", "message"), 256)
    w = Window.partitionBy("pkg_id", "base").orderBy(F.coalesce("line_no", F.lit(-1)), F.coalesce("col_no", F.lit(-1)))
    numbered = findings.withColumn("base", base).withColumn("occurrence", F.row_number().over(w) - 1)
    return numbered.withColumn("fingerprint", F.sha2(F.concat_ws("\x1f", "base", F.col("occurrence").cast("string")), 256))


def headline(findings: DataFrame) -> DataFrame:
    """BLOCKING, FINDINGS or CLEAN by package."""
    blocking = (F.col("vector") != "") & F.col("severity").isin("critical", "high")
    any_ = (F.col("vector") != "") | (F.col("severity") != "low")
    return findings.groupBy("pkg_id").agg(F.when(F.bool_or(blocking), "BLOCKING").when(F.bool_or(any_), "FINDINGS").otherwise("CLEAN").alias("verdict"))
