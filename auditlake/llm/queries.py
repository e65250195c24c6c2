"""Queries of the text operators over the test tables; each runs over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, encoding_repair, leakage, markup, packing, spam_pages, syntax_check, visual_form
from .common import read, spread


def _artifacts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(read(spark, sf_dir, "artifacts").select("artifact_id", *columns))


# -- problem 1: look-alike texts -------------------------------------------------------------------


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_form.visual_twins(_artifacts(spark, sf_dir, "text"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_form.visual_classes(_artifacts(spark, sf_dir, "text"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between the first files of different texts that look the same."""
    return visual_form.visual_links(_artifacts(spark, sf_dir, "text"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's text in the consistent form; a file delivered again gives one row."""
    out = visual_form.visual_form(_artifacts(spark, sf_dir, "text"), "artifact_id", "text")
    return out.withColumnRenamed("id", "artifact_id").dropDuplicates(["artifact_id"])


# -- problem 2: markup residue ---------------------------------------------------------------------


def _markup(spark: SparkSession, sf_dir: str, each: Callable) -> DataFrame:
    prose = F.col("kind").isin("skill_manifest", "agent_identity", "instruction", "doc") | (F.col("kind") == "other") & F.col("rel").endswith(".txt")
    files = spread(read(spark, sf_dir, "artifacts").where(prose & F.col("text").isNotNull()).select("artifact_id", "text"))
    comments = read(spark, sf_dir, "html_comments").select("comment_id", "body")
    blocks = read(spark, sf_dir, "html_prose").select("prose_id", "text")
    return (
        each(files, "artifact_id", "text", "artifact", True)
        .unionByName(each(comments, "comment_id", "body", "comment"))
        .unionByName(each(blocks, "prose_id", "text", "prose"))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markup(spark, sf_dir, markup.markup_families).distinct()


def p2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each family of markup is densest in each record."""
    return _markup(spark, sf_dir, markup.markup_regions).distinct()


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every record; a file delivered again gives one row."""
    return _markup(spark, sf_dir, markup.clean_texts).dropDuplicates(["record_kind", "record_id"])


# -- problem 3: files that do not parse ------------------------------------------------------------


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_check.syntax_flags(_artifacts(spark, sf_dir, "pkg_id", "rel", "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).where("not is_valid").select("artifact_id").distinct()


def p3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("artifact_id", "language", "is_valid", "reason").distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_check.invalid_rates(_flags(spark, sf_dir), read(spark, sf_dir, "packages"))


# -- problem 4: wrong decodings --------------------------------------------------------------------


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.repaired(_artifacts(spark, sf_dir, "text", "exception", "raw"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("artifact_id").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).dropDuplicates(["artifact_id"])


# -- problem 5: credentials ------------------------------------------------------------------------


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_places(_artifacts(spark, sf_dir, "rel", "text")).select("artifact_id", "line_no").distinct()


def p5_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_places(_artifacts(spark, sf_dir, "rel", "text")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted(_artifacts(spark, sf_dir, "rel", "text")).dropDuplicates(["artifact_id"])


# -- problem 6: containers -------------------------------------------------------------------------


def _limits(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The table of capacities has a row a purpose; it is read as parameters."""
    return [(r[0], r[1]) for r in read(spark, sf_dir, "pack_limits").select("limit_id", "capacity_tokens").distinct().orderBy("limit_id").collect()]


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), _limits(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_containers(spark, sf_dir), _limits(spark, sf_dir))


# -- problem 7: held-out passages in the corpus ----------------------------------------------------


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "bench_records")
    held = F.col("split").isin("test", "dev")
    return leakage.passages(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), records.where(held), others=records.where(~held | F.col("split").isNull()))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("doc_id", "benchmark_id").distinct()


def p7_leaked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which held-out records leaked: documents, passages and the longest passage of each."""
    return (
        _passages(spark, sf_dir)
        .groupBy("benchmark_id")
        .agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_passages"), F.max("matched_words").alias("longest_words"))
    )


def p7_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.removal_spans(_passages(spark, sf_dir))


# -- problem 8: keyword and link pages -------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages.fitted_labels(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).where("is_spam").select("doc_id").distinct()


def p8_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_classes, p1_links, p1_forms, p2_found, p2_regions, p2_clean, p3_found, p3_flags, p3_rates, p4_found, p4_restored, p5_found, p5_places, p5_redacted,
        p6_containers, p6_fill, p7_found, p7_leaked_records, p7_removal_spans, p8_found, p8_labels,
    )
}
