"""Candidates to results: coverage, grouping, context digests, review policies, capability triads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.vectors import severity_rank
from . import grants as grant_rules
from . import inspect
from . import ledger as coverage_ledger


def candidates(findings: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Findings with a digest id and ``coverage``: incomplete where a gap names their path, or a gap of the package names none.

    ``gaps`` are the findings without a vector, where they are known apart.
    """
    gap = (findings if gaps is None else gaps).where((F.coalesce("vector", F.lit("")) == "") & coverage_ledger.is_gap(F.col("rule"), F.col("severity"), F.col("message")))
    paths = gap.where("path <> ''").select("pkg_id", "path").distinct().withColumn("_p", F.lit(True))
    whole = gap.where("path is null or path = ''").select("pkg_id").distinct().withColumn("_w", F.lit(True))
    out = findings.join(paths, ["pkg_id", "path"], "left").join(whole, "pkg_id", "left")
    ident = F.sha2(F.concat_ws("\x1f", "pkg_id", "path", "vector", "rule", "severity", "message", F.coalesce("line_no", F.lit(-1)).cast("string")), 256)
    analyzer = F.when(F.col("rule").rlike("^E[0-9]{2}-"), "code-engine").when(F.col("vector") == "SXV-038", "review").otherwise("ir-check")
    return out.withColumn("candidate_id", ident).withColumn("analyzer", analyzer).withColumn("coverage", F.when(F.col("_p") | F.col("_w"), "incomplete").otherwise("complete")).drop("_p", "_w")


def result_key(anchor: str | None = None) -> Column:
    """Key of equivalent candidates: vector, path and place, with the message unless vector and place (and, where given, the anchor) are known."""
    known = (F.coalesce("vector", F.lit("")) != "") & F.col("line_no").isNotNull()
    if anchor:
        known = known & F.col(anchor).isNotNull()
    return F.sha2(F.concat_ws("\x1f", "pkg_id", "path", "vector", F.coalesce("line_no", F.lit(-1)).cast("string"), F.when(known, F.lit("")).otherwise(F.col("message"))), 256)


def results(cands: DataFrame, anchor: str | None = None) -> DataFrame:
    """Equivalent candidates as one result, with the analyzers it comes from; ``links`` has its candidates as rows."""
    keyed = cands.withColumn("result_key", result_key(anchor))
    return keyed.groupBy("pkg_id", "path", "result_key").agg(
        F.min("vector").alias("vector"), F.min("rule").alias("rule"), F.min_by("severity", severity_rank()).alias("severity"), F.min("line_no").alias("line_no"),
        F.count("*").alias("n_candidates"), F.min("candidate_id").alias("first_candidate"), F.max("coverage").alias("coverage"), F.array_join(F.array_sort(F.collect_set("analyzer")), ",").alias("provenance"),
    )


def links(cands: DataFrame, anchor: str | None = None) -> DataFrame:
    """``pkg_id, result_key, candidate_id, link``: the least candidate of a result is reported, the others are its duplicates.

    The least one comes from an aggregate, so no result gathers its candidates.
    """
    keyed = cands.select("pkg_id", result_key(anchor).alias("result_key"), "candidate_id").distinct()
    first = keyed.groupBy("pkg_id", "result_key").agg(F.min("candidate_id").alias("_first"))
    return keyed.join(first, ["pkg_id", "result_key"]).withColumn("link", F.when(F.col("candidate_id") == F.col("_first"), "reported").otherwise("duplicate")).drop("_first")


def context_digests(artifacts: DataFrame) -> DataFrame:
    """Digest of all files of a package: changes when any of them does.

    Each file is reduced to a digest where it is read; a package gathers only
    those.  Digests are folded by hashed slice first, so that the package with a
    tenth of all files gathers at most ``slices`` values at the end.
    """
    one = artifacts.select("pkg_id", "rel", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d")).distinct()
    sliced = one.groupBy("pkg_id", F.substring(F.sha2("rel", 256), 1, 2).alias("slice")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "rel", "d"))), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return sliced.groupBy("pkg_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "slice", "d"))), "\n"), 256).alias("context_digest"), F.sum("n").alias("n_files"))


def dispositions(res: DataFrame, policy: DataFrame) -> DataFrame:
    """Review decisions by exact (rule, path, fingerprint, context): suppress, or demote to a lower severity; incomplete or diagnostic results are retained."""
    scope = ["rule", "path", "fingerprint", "context_digest"]
    out = res.join(policy.select(*scope, "action", F.col("effective_severity").alias("_to"), "reason"), scope, "left")
    protected = (F.coalesce("vector", F.lit("")) == "") | (F.col("coverage") == "incomplete")
    lower = severity_rank("_to") > severity_rank("severity")
    what = F.when(F.col("action").isNull() | protected, "retained").when(F.col("action") == "suppress", "suppressed").when((F.col("action") == "demote") & lower, "demoted").otherwise("retained")
    out = out.withColumn("disposition", what)
    return out.withColumn("effective_severity", F.when(F.col("disposition") == "demoted", F.col("_to")).otherwise(F.col("severity"))).drop("_to", "action")


def unmatched_decisions(res: DataFrame, policy: DataFrame) -> DataFrame:
    return policy.join(res, ["rule", "path", "fingerprint", "context_digest"], "left_anti")


AXES = ("execution", "network")


def axis_of(rule: str = "rule") -> Column:
    """Axis of a capability rule."""
    return F.when(F.col(rule).contains("network"), "network").otherwise("execution")


@F.pandas_udf(BooleanType())
def _reaches(tool: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([grant_rules.reaches_network(t, p) for t, p in zip(tool, pattern)], dtype=bool)


def declarations(grants: DataFrame) -> DataFrame:
    """Declared state of each axis for the manifests that list tools: ``pkg_id, manifest, side, axis, state``.

    Grants that a denial covers do not count.  An axis is present if an effective
    grant reaches it, unknown if a grant could not be parsed, else denied.
    """
    key = ["pkg_id", "manifest"]
    named = grants.withColumn("manifest", F.col("rel"))
    listed = named.groupBy(*key).agg(F.bool_or(~F.col("parsed")).alias("unparsed"), F.bool_or("allowed").alias("lists")).where("lists")
    tool = F.lower("tool")
    reached = inspect.effective_grants(grants).where("parsed").groupBy("pkg_id", F.col("rel").alias("manifest")).agg(
        F.bool_or(tool.isin(*grant_rules.EXECUTION_TOOLS, "*")).alias("execution"), F.bool_or(_reaches("tool", "pattern")).alias("network")
    )
    state = lambda axis: F.when(F.coalesce(F.col(axis), F.lit(False)), "present").when(F.col("unparsed"), "unknown").otherwise("denied")
    both = listed.join(reached, key, "left")
    return both.select(*key, F.lit("declared").alias("side"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), state(a).alias("state")) for a in AXES])).alias("x")).select(*key, "side", "x.axis", "x.state")


def triads(manifests: DataFrame, claims: DataFrame, observed: DataFrame, gaps: DataFrame) -> DataFrame:
    """Claimed, declared and observed state of each axis for every manifest.

    ``manifests``: pkg_id, manifest; ``claims``: pkg_id, manifest, side
    (claimed or declared), axis, state; ``observed``: pkg_id, manifest, axis;
    ``gaps``: pkg_id, manifest (null counts for every manifest of the package).
    Two states on one side are a conflict and give unknown.
    """
    axes = manifests.select("pkg_id", "manifest", F.explode(F.array(*[F.lit(a) for a in AXES])).alias("axis"))
    side = claims.groupBy("pkg_id", "manifest", "axis").agg(
        *[F.when(F.size(F.collect_set(F.when(F.col("side") == s, F.col("state")))) == 1, F.max(F.when(F.col("side") == s, F.col("state")))).otherwise("unknown").alias(s) for s in ("claimed", "declared")]
    )
    seen = observed.select("pkg_id", "manifest", "axis").distinct().withColumn("_seen", F.lit(True))
    own = gaps.where("manifest is not null").select("pkg_id", "manifest").distinct().withColumn("_own", F.lit(True))
    whole = gaps.where("manifest is null").select("pkg_id").distinct().withColumn("_whole", F.lit(True))
    out = axes.join(side, ["pkg_id", "manifest", "axis"], "left").join(seen, ["pkg_id", "manifest", "axis"], "left").join(own, ["pkg_id", "manifest"], "left").join(whole, "pkg_id", "left")
    state = F.when(F.col("_seen"), "present").when(F.col("_own") | F.col("_whole"), "unknown").otherwise("denied")
    return out.select("pkg_id", "manifest", "axis", F.coalesce("claimed", F.lit("unknown")).alias("claimed"), F.coalesce("declared", F.lit("unknown")).alias("declared"), state.alias("observed"))


def understated(triad: DataFrame) -> DataFrame:
    """Axes a manifest uses without declaring them."""
    return triad.where((F.col("observed") == "present") & (F.col("declared") == "denied"))


def reused(cands: DataFrame, order: Column | str = "candidate_id") -> DataFrame:
    """Earliest candidate (by ``order``) of the same evidence, whose outcome the later ones take over: an aggregate, so no window holds a hot group."""
    key = ["pkg_id", "vector", "rule", "message"]
    first = cands.groupBy(*key).agg(F.min(order).alias("outcome_of"))
    return cands.join(first, key)
