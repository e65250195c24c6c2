"""Where findings stand in their source: known positions, the text of a region, anchors that survive moved lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def located(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings with ``source_known``: whether their line (and column) exists in the text of their file.

    Only the number of lines and the lengths of lines meet the findings, computed where the texts are read.
    """
    sizes = texts.where("text is not null").select("pkg_id", F.col("rel").alias("path"), F.transform(F.split("text", "\n", -1), lambda x: F.length(x)).alias("_sizes")).dropDuplicates(["pkg_id", "path"])
    known = (F.col("line_no") >= 1) & (F.col("line_no") <= F.size("_sizes")) & (F.col("col_no").isNull() | (F.col("col_no") >= 1) & (F.col("col_no") <= F.get("_sizes", F.col("line_no") - 1) + 1))
    return findings.join(sizes, ["pkg_id", "path"], "left").withColumn("source_known", F.coalesce(F.col("_sizes").isNotNull() & known, F.lit(False))).drop("_sizes")


def regions(findings: DataFrame, texts: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """``region``: the lines of each finding with ``before`` and ``after`` neighbours; a finding without a known line gives none.

    The wanted line numbers of a file meet its text by equality on the file, so a text is read once whatever the number of its findings.
    """
    wanted = findings.where("line_no is not null").groupBy("pkg_id", "path").agg(F.sort_array(F.collect_set("line_no")).alias("_wanted"))
    rows = texts.where("text is not null").select("pkg_id", F.col("rel").alias("path"), F.split("text", "\n", -1).alias("_lines")).dropDuplicates(["pkg_id", "path"])
    each = rows.join(wanted, ["pkg_id", "path"]).select("pkg_id", "path", "_lines", F.explode("_wanted").alias("line_no")).where((F.col("line_no") >= 1) & (F.col("line_no") <= F.size("_lines")))
    first = F.greatest(F.col("line_no") - before, F.lit(1))
    return each.select("pkg_id", "path", "line_no", F.array_join(F.slice("_lines", first, F.col("line_no") + after - first + 1), "\n").alias("region"))


def slice_text(text: str, start_line: int, start_col: int, end_line: int, end_col: int) -> str | None:
    """Text between two 1-based places (the second one not included); None for places that are turned round or not in the text."""
    lines = text.split("\n")
    if not (1 <= start_line <= end_line <= len(lines)) or (start_line, start_col) > (end_line, end_col):
        return None
    if not (1 <= start_col <= len(lines[start_line - 1]) + 1 and 1 <= end_col <= len(lines[end_line - 1]) + 1):
        return None
    if start_line == end_line:
        return lines[start_line - 1][start_col - 1 : end_col - 1]
    return "\n".join([lines[start_line - 1][start_col - 1 :], *lines[start_line : end_line - 1], lines[end_line - 1][: end_col - 1]])


def anchored(regions_: DataFrame) -> DataFrame:
    """``anchor``: digest of the lines of a region that are not blank, each without blanks at its ends; null where none is left."""
    kept = F.filter(F.transform(F.split("region", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return regions_.withColumn("anchor", F.when(F.size(kept) > 0, F.sha2(F.array_join(kept, "\n"), 256))).drop("region")
