"""Reports as rows, their referential checks, review policies and capability claims."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import severity_rank

MAX_DECISIONS = 512
MAX_REASON = 1024
_DIGEST = re.compile(r"[0-9a-f]{64}")


#: Results of a package that go into one document; a package with more gives an error row, and its results stay rows.
MAX_RESULTS = 50_000


def package_reports(res: DataFrame, most: int = MAX_RESULTS) -> DataFrame:
    """One JSON document a package: results in finding order and the sorted distinct rule ids; ``error`` where there are too many for one.

    The results are counted before they are gathered, so no row grows beyond the bound.
    """
    n = res.groupBy("pkg_id").agg(F.count("*").alias("n_results"))
    large = n.where(F.col("n_results") > most).select("pkg_id", F.col("n_results").cast("int").alias("n_results"), F.lit(None).cast("string").alias("report"), F.lit("too many results for one document").alias("error"))
    item = F.struct(severity_rank().alias("rank"), "path", F.coalesce("line_no", F.lit(-1)).alias("at"), "vector", "rule", "severity")
    some = res.join(n.where(F.col("n_results") <= most).select("pkg_id"), "pkg_id", "left_semi")
    grouped = some.groupBy("pkg_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.array_sort(F.collect_set("rule")).alias("rules"))
    results = F.transform("items", lambda x: F.struct(x["rule"].alias("ruleId"), x["severity"].alias("level"), x["path"].alias("uri"), F.when(x["at"] >= 0, x["at"]).alias("startLine")))
    ok = grouped.select("pkg_id", F.size("items").alias("n_results"), F.to_json(F.struct(F.col("rules"), results.alias("results"))).alias("report"), F.lit(None).cast("string").alias("error"))
    return ok.unionByName(large)


def reported_headline(dispositions: DataFrame) -> DataFrame:
    """Verdict of each package after review: suppressed results do not count, demoted ones count with their effective severity."""
    left = dispositions.where("disposition <> 'suppressed'")
    strong = (F.col("vector") != "") & F.col("effective_severity").isin("critical", "high")
    any_ = (F.col("vector") != "") | (F.col("effective_severity") != "low")
    by = left.groupBy("pkg_id").agg(F.when(F.bool_or(strong), "BLOCKING").when(F.bool_or(any_), "FINDINGS").otherwise("CLEAN").alias("verdict"))
    return dispositions.select("pkg_id").distinct().join(by, "pkg_id", "left").select("pkg_id", F.coalesce("verdict", F.lit("CLEAN")).alias("verdict"))


def policy_summary(dispositions: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Decisions of a policy by effect: suppressed, demoted and unmatched."""
    return dispositions.agg(F.count_if(F.col("disposition") == "suppressed").alias("suppressed"), F.count_if(F.col("disposition") == "demoted").alias("demoted")).withColumn("unmatched", F.lit(unmatched.count()))


def locations(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings with ``region`` (JSON of the place that the text of the file bears out) and ``limitation`` (why a place they name is not shown)."""
    from .anchors import located

    at = located(findings, texts)
    region = F.to_json(F.struct(F.col("line_no").alias("startLine"), F.col("col_no").alias("startColumn")))
    return at.withColumn("region", F.when(F.col("source_known"), region)).withColumn("limitation", F.when(F.col("line_no").isNotNull() & ~F.col("source_known"), "source-unproven"))


LEVELS = {"error", "warning", "note", "none"}


def validate(document: object) -> list[str]:
    """What is wrong with a report document: its shape, rules that results name but do not list, places that are none, links between results and candidates."""
    wrong: list[str] = []
    if not isinstance(document, dict) or document.get("version") != "2.1.0" or not isinstance(document.get("runs"), list):
        return ["a report has version 2.1.0 and runs"]
    for n, run in enumerate(document["runs"]):
        try:
            rules = {r["id"] for r in run["tool"]["driver"].get("rules", [])}
            results = run["results"]
        except (KeyError, TypeError):
            wrong.append(f"run {n}: no tool or results")
            continue
        for k, r in enumerate(results):
            where = f"run {n} result {k}"
            if not isinstance(r, dict) or not isinstance(r.get("message"), dict) or not isinstance(r["message"].get("text"), str):
                wrong.append(f"{where}: no message")
                continue
            if r.get("ruleId") not in rules:
                wrong.append(f"{where}: rule not listed")
            if r.get("level", "warning") not in LEVELS:
                wrong.append(f"{where}: level")
            for place in r.get("locations", []):
                physical = place.get("physicalLocation", {}) if isinstance(place, dict) else {}
                uri, region = physical.get("artifactLocation", {}).get("uri"), physical.get("region", {})
                if not isinstance(uri, str) or uri.startswith("/") or ".." in uri.split("/"):
                    wrong.append(f"{where}: path")
                if any(not isinstance(v, int) or isinstance(v, bool) or v < 1 for key, v in region.items() if key in ("startLine", "endLine", "startColumn", "endColumn")) or region.get("endLine", region.get("startLine", 1)) < region.get("startLine", 1):
                    wrong.append(f"{where}: region")
        known = {c.get("id") for c in run.get("properties", {}).get("candidates", []) if isinstance(c, dict)}
        for link in run.get("properties", {}).get("links", []):
            if link.get("candidate") not in known or not isinstance(link.get("result"), int) or not 0 <= link["result"] < len(results):
                wrong.append(f"run {n}: dangling link")
    return wrong


def dangling(links: DataFrame, results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links whose result or candidate does not exist: ``kind, id``; a sound report has none."""
    r = links.join(results, "result_id", "left_anti").select(F.lit("result").alias("kind"), F.col("result_id").alias("id"))
    c = links.join(candidates, "candidate_id", "left_anti").select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id"))
    return r.unionByName(c).distinct()


def check_policy(policy: object) -> list[dict]:
    """Decisions of a policy document; the whole policy is refused on any error."""
    if not isinstance(policy, dict) or set(policy) != {"version", "decisions"} or not isinstance(policy["decisions"], list) or not isinstance(policy["version"], str):
        raise ValueError("a policy has a version and decisions")
    if len(policy["decisions"]) > MAX_DECISIONS:
        raise ValueError("too many decisions")
    seen = set()
    for d in policy["decisions"]:
        need = {"rule_id", "path", "fingerprint", "context_digest", "action", "reason"}
        if not isinstance(d, dict) or not need <= set(d) or set(d) - need - {"effective_severity"}:
            raise ValueError("a decision has exactly its keys")
        if not all(isinstance(v, str) and v for v in d.values()) or len(d["reason"]) > MAX_REASON:
            raise ValueError("values are short texts")
        if not _DIGEST.fullmatch(d["fingerprint"]) or not _DIGEST.fullmatch(d["context_digest"]):
            raise ValueError("digests have 64 hex digits")
        if d["path"].startswith("/") or ".." in d["path"].split("/"):
            raise ValueError("paths stay inside the package")
        if d["action"] not in ("suppress", "demote") or (d["action"] == "demote") != ("effective_severity" in d) or d.get("effective_severity", "low") not in ("high", "medium", "low"):
            raise ValueError("an action is suppress, or demote with a severity")
        key = (d["rule_id"], d["path"], d["fingerprint"], d["context_digest"])
        if key in seen:
            raise ValueError("decisions must not repeat")
        seen.add(key)
    return policy["decisions"]


_CLAIM = re.compile(r"(?i)^(?:this skill|it)?\s*(?P<neg>does not|doesn't|never|will not|won't|cannot|makes no)?\s*(?:(?:ever|only|also)\s+)?(?P<verb>runs?|executes?|invokes?|access(?:es)?|uses?|contacts?|connects? to|calls?|makes?)\s+(?P<none>no\s+)?(?:any\s+|the\s+)?(?P<what>commands?|scripts?|code|processes|programs?|shell|network(?:\s+(?:requests?|calls?|access))?|internet|requests?|remote servers?)\.?$")
_AXIS = {"execution": ("command", "script", "code", "process", "program", "shell"), "network": ("network", "internet", "request", "remote")}


def read_policy(path: str, outside: str | None = None) -> list[dict]:
    """Decisions of a policy file: a regular JSON file of at most 512 KiB that does not lie in the package."""
    import json
    from pathlib import Path

    p = Path(path)
    if p.is_symlink() or not p.is_file():
        raise ValueError("a policy is a regular file")
    if outside and p.resolve().is_relative_to(Path(outside).resolve()):
        raise ValueError("a policy must not lie in the package")
    if p.stat().st_size > 512 << 10:
        raise ValueError("a policy has at most 512 KiB")
    return check_policy(json.loads(p.read_text("utf-8")))


def manifest_claims(texts: DataFrame) -> DataFrame:
    """Claims of the manifests ``(pkg_id, rel, kind, text)``: ``pkg_id, manifest, side, axis, state`` from the description and a leading "This skill" paragraph, and the limits as rows without an axis."""
    from .inspect import _map
    from .markdown import front_matter

    def one(pkg: str, rel: str, text: str) -> list[tuple]:
        values, _, end, _ = front_matter(text)
        description = values.get("description")
        states, limits = claims(description if isinstance(description, str) else None)
        lead = next((p for p in re.split(r"\n[ \t]*\n", "\n".join(text.split("\n")[end:])) if p.strip() and not p.lstrip().startswith("#")), "")
        more, others = claims(" ".join(lead.split())) if lead.strip().startswith("This skill ") else ({}, [])
        for axis, state in more.items():
            if states.get(axis, state) != state:
                others.append(f"claim_conflict:{axis}")
            states.setdefault(axis, state)
        return [(pkg, rel, "claimed", a, s) for a, s in states.items()] + [(pkg, rel, "limit", None, x) for x in limits + others]

    return _map(texts.where("text is not null and kind = 'skill_manifest'"), ["pkg_id", "rel", "text"], one, "pkg_id string, manifest string, side string, axis string, state string").distinct()


def claims(description: str | None) -> tuple[dict[str, str], list[str]]:
    """Capability states a description claims; one statement outside the grammar voids the whole source, two that differ are a conflict."""
    if not description:
        return {}, []
    if len(description) > 400:
        return {}, ["claim_too_long"]
    states: dict[str, set[str]] = {}
    for statement in re.split(r"(?<=[.!?])\s+", description.strip()):
        m = _CLAIM.match(statement.strip())
        if not m:
            return {}, ["claim_unrecognised"]
        axis = next(a for a, words in _AXIS.items() if m["what"].lower().startswith(words))
        states.setdefault(axis, set()).add("denied" if m["neg"] or m["none"] else "present")
    limits = [f"claim_conflict:{a}" for a, s in states.items() if len(s) > 1]
    return {a: s.pop() for a, s in states.items() if len(s) == 1}, limits
