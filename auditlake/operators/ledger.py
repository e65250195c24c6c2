"""Coverage ledger: what was read, what was not, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BENIGN = ("excluded_dir",)
# Parse-phase reasons that are notes.
LOW_PARSE = ("config_parse_error", "dep_manifest_unparsed", "frontmatter_parse_error", "grants_unparsed_shape", "markdown_parse_error", "raw_html_markup", "requirement_unparsed", "unmodeled_content", "unsupported_markup")

# Languages of source files that no check reads, by extension; build and infrastructure files are none of them.
UNREAD_SOURCE = {
    ".go": "Go", ".rs": "Rust", ".php": "PHP", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".swift": "Swift", ".c": "C", ".h": "C", ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".hpp": "C++", ".cs": "C#", ".lua": "Lua", ".r": "R", ".scala": "Scala", ".dart": "Dart",
    ".ex": "Elixir", ".exs": "Elixir", ".hs": "Haskell", ".m": "Objective-C or MATLAB", ".mm": "Objective-C", ".zig": "Zig", ".nim": "Nim", ".jl": "Julia", ".vb": "Visual Basic", ".vbs": "VBScript", ".fs": "F# or Forth", ".fsx": "F#", ".clj": "Clojure", ".erl": "Erlang", ".groovy": "Groovy",
    ".ksh": "ksh", ".fish": "fish", ".csh": "csh", ".tcsh": "tcsh", ".awk": "awk", ".ahk": "AutoHotkey", ".applescript": "AppleScript", ".ml": "OCaml", ".pas": "Pascal", ".f90": "Fortran", ".cr": "Crystal", ".rkt": "Racket", ".lisp": "Lisp", ".d": "D", ".pyx": "Cython", ".psm1": "PowerShell", ".v": "V or Verilog", ".elm": "Elm",
}


def files(artifacts: DataFrame) -> DataFrame:
    """A file once, however often it was delivered; no text is carried."""
    return artifacts.select("artifact_id", "pkg_id", "rel", "kind", "role", F.coalesce("exception", F.lit("")).alias("exception")).distinct()


def unmatched(artifact_files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger entries left when each artifact exception takes one entry of its path and reason: ``pkg_id, path, reason_code, n``."""
    taken = artifact_files.where("exception <> ''").groupBy("pkg_id", F.col("rel").alias("path"), F.col("exception").alias("reason_code")).agg(F.count("*").alias("taken"))
    noted = ledger.groupBy("pkg_id", "path", "reason_code").agg(F.count("*").alias("noted"))
    left = F.greatest(F.col("noted") - F.coalesce("taken", F.lit(0)), F.lit(0))
    return noted.join(taken, ["pkg_id", "path", "reason_code"], "left").withColumn("n", left).where("n > 0").select("pkg_id", "path", "reason_code", "n")


def coverage(artifact_files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counts and coverage percent of each package; inert assets and shipped compiled code leave the denominator."""
    e = F.col("exception")
    out_of_scope = ((F.col("kind") == "asset") & (e == "binary_content")) | ((F.col("role") == "compiled") & (e == "shipped_compiled"))
    per = artifact_files.groupBy("pkg_id").agg(
        F.count_if(e == "").alias("analyzed"), F.count_if((e != "") & out_of_scope).alias("not_inspectable"), F.count_if((e != "") & ~out_of_scope).alias("failed_files")
    )
    skips = unmatched(artifact_files, ledger).where(~F.col("reason_code").isin(*BENIGN)).groupBy("pkg_id").agg(F.sum("n").alias("skips"))
    out = per.join(skips, "pkg_id", "full").na.fill(0, ["analyzed", "not_inspectable", "failed_files", "skips"])
    out = out.withColumn("failed", F.col("failed_files") + F.col("skips")).withColumn("denominator", F.col("analyzed") + F.col("failed"))
    percent = F.when(F.col("denominator") > 0, F.round(100.0 * F.col("analyzed") / F.col("denominator"), 2)).otherwise(F.lit(100.0))
    return out.withColumn("seen", F.col("analyzed") + F.col("not_inspectable") + F.col("failed")).withColumn("coverage_percent", percent).select("pkg_id", "seen", "analyzed", "not_inspectable", "failed", "denominator", "coverage_percent")


def by_role(artifact_files: DataFrame) -> DataFrame:
    return artifact_files.groupBy("pkg_id", "role").agg(F.count("*").alias("n"))


def static_severity(reason: Column, kind: Column, path: Column) -> Column:
    """low for benign skips and drawings nobody could review, null for no gap, else high."""
    return (
        F.when(reason.isin(*BENIGN), "low")
        .when((reason == "binary_content") & (kind == "asset"), None)
        .when((reason == "unreviewable_content") & (kind == "active_asset") & F.lower(path).endswith(".svg"), "low")
        .otherwise("high")
    )


def unread_language(path: Column) -> Column:
    """Language of a source file that no check reads, by its extension; null for other files."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in UNREAD_SOURCE.items() for x in pair]), ext)


def coverage_findings(artifact_files: DataFrame, ledger: DataFrame) -> DataFrame:
    """One finding a distinct (phase, reason, path): ``analysis-incomplete`` (high, medium for source that no check reads) or the low ``coverage-note``."""
    gaps = ledger.select("pkg_id", "path", F.coalesce(F.nullif("phase", F.lit("")), F.lit("static")).alias("phase"), F.coalesce(F.nullif("reason_code", F.lit("")), F.lit("unknown")).alias("reason")).distinct()
    kinds = artifact_files.groupBy("pkg_id", F.col("rel").alias("path")).agg(F.min("kind").alias("kind"))
    unread = F.when((F.col("phase") == "parse") & (F.col("reason") == "unmodeled_content"), unread_language(F.col("path")))
    severity = (
        F.when(F.col("unread").isNotNull(), "medium")
        .when(F.col("phase") == "parse", F.when(F.col("reason").isin(*LOW_PARSE), "low").otherwise("high"))
        .otherwise(static_severity(F.col("reason"), F.coalesce("kind", F.lit("")), F.col("path")))
    )
    out = gaps.join(kinds, ["pkg_id", "path"], "left").withColumn("unread", unread).withColumn("severity", severity).where("severity is not null")
    plain = F.concat(F.col("phase"), F.lit(" analysis coverage is incomplete ("), F.col("reason"), F.lit(")."))
    named = F.concat(F.col("path"), F.lit(" was read but not analyzed: no lane covers "), F.col("unread"), F.lit("."))
    return out.select(
        "pkg_id", "path", F.lit("").alias("vector"), F.when(F.col("severity") == "low", "coverage-note").otherwise("analysis-incomplete").alias("rule"), "severity",
        F.when(F.col("unread").isNotNull(), named).otherwise(plain).alias("message"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("int").alias("col_no"),
    )


def is_inventory_note(rule: Column, severity: Column, message: Column) -> Column:
    """Whether a finding without a vector only notes a benign skip of the static phase; its message carries phase and reason."""
    said = [F.lit(f"static analysis coverage is incomplete ({r}).") for r in BENIGN]
    return (rule == "coverage-note") & (severity == "low") & message.isin(*said)


def is_gap(rule: Column, severity: Column, message: Column) -> Column:
    """Whether a finding without a vector marks something that was not analysed."""
    return ~is_inventory_note(rule, severity, message)


def material_gaps(artifact_files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries of the ledger that may hide context: all outside the static phase, and static ones that are neither benign nor ungraded."""
    kinds = artifact_files.groupBy("pkg_id", F.col("rel").alias("path")).agg(F.min("kind").alias("kind"))
    phase = F.coalesce(F.nullif("phase", F.lit("")), F.lit("static"))
    reason = F.coalesce(F.nullif("reason_code", F.lit("")), F.lit("unknown"))
    graded = ledger.join(kinds, ["pkg_id", "path"], "left").withColumn("_s", static_severity(reason, F.coalesce("kind", F.lit("")), F.col("path")))
    return graded.where((phase != "static") | ~reason.isin(*BENIGN) & F.col("_s").isNotNull()).select("pkg_id", "path", phase.alias("phase"), reason.alias("reason"))
