"""The whole scan: every check in registry order, one relation of findings, verdicts."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import requirements
from ..functions.vectors import severity_rank
from ..operators import correlate, detect, engine, findings, forensics, graph, grants, hooks, inspect, instruction, ledger, markdown
from ..operators.findings import COLUMNS
from ..operators.inspect import FINDING

#: Order of the checks; part of the contract, as findings that tie keep it.
CHECKS = ("forensics", "coverage", "grants", "hooks", "instruction", "metadata", "obfuscation", "persistence", "preproc", "supply_chain", "code")
def _row(path: str, vector: str, rule: str, severity: str, message: str, line: int | None = None, column: int | None = None) -> tuple:
    return path, vector, rule, severity, message, line, column


def _forensics(rel, kind, text, raw):
    return [_row(rel, f.vector, f.rule, f.severity, f.message) for f in forensics.byte_findings(rel, bytes(raw))] if raw is not None else []


def _grants(rel, kind, text, raw):
    out = []
    listed = inspect.front_matter_grants(text) if kind == "skill_manifest" and text else []
    denied = [(t, p) for t, p, parsed, _, ok in listed if parsed and not ok]
    for tool, pattern, parsed, wide, allowed in listed:
        if not allowed or not parsed or any(tool == d and grants.covers(q, pattern) for d, q in denied):
            continue
        shown = f"{tool}({pattern})" if pattern is not None else tool
        if grants.dynamic(tool, pattern):
            out.append(_row(rel, "SXV-003", "grant-variable-substitution", "high", shown))
        if wide and wide != "variable_substitution":
            out.append(_row(rel, "SXV-004", "grant-over-broad", "critical" if wide in ("wildcard_all_commands", "privilege_escalation") else "high", f"{wide} {shown}"))
    return out


def _hooks(rel, kind, text, raw):
    """Hooks that name no file are findings at once; those that name one are looked up in the package (rule ``hook-target``)."""
    out = [_row(rel, *f) for f in hooks.hook_findings(rel, text)] if text and kind in inspect.HOOK_KINDS else []
    doc = hooks.document(rel, text) if text and kind in inspect.SERVER_KINDS else None
    return out + [_row(rel, "SXV-013", "floating-mcp-package", "low", f"{runner} {package}") for _, runner, package, pinned in hooks.servers(doc or {}) if not pinned]


def _reaches(text: str) -> bool | None:
    """Whether the effective grants of a manifest reach the network; None where it declares none."""
    listed = inspect.front_matter_grants(text)
    denied = [(t, p) for t, p, parsed, _, ok in listed if parsed and not ok]
    allowed = [(t, p) for t, p, parsed, _, ok in listed if parsed and ok and not any(t == d and grants.covers(q, p) for d, q in denied)]
    return any(grants.reaches_network(t, p) for t, p in allowed) if any(ok for *_, ok in listed) else None


def _directives(rel, kind, text, raw):
    if not text or kind not in markdown.KINDS:
        return []
    return [_row(rel, *x) for x in instruction.directives(text, _reaches(text) if kind == "skill_manifest" else None)]


def _metadata(rel, kind, text, raw):
    return [_row(rel, "SXV-034", "unsafe-yaml-tag", "critical", tag, n, c) for tag, n, c in markdown.unsafe_tags(text)] if kind == "skill_manifest" and text else []


def _characters(rel, kind, text, raw):
    return [_row(rel, *x) for x in inspect.character_findings(text, kind in markdown.KINDS)] if text and not text.isascii() else []


def _preproc(rel, kind, text, raw):
    out, seen = [], {}
    for token, code, n, c, runs in markdown.bang_tokens(text) if text and kind in markdown.KINDS and ("!`" in text or "```!" in text) else ():
        if runs:
            seen[token] = seen.get(token, 0) + 1
            if seen[token] <= markdown.TOKENS_KEPT:
                digest = hashlib.sha256(code.encode("utf-8", "surrogatepass")).hexdigest()
                out.append(_row(rel, "SXV-002" if token == "fenced" else "SXV-001", f"preproc-{token}-bang", "critical", digest, n, c))
    return out + [_row(rel, "", "findings-capped", "low", f"preproc-{t}-bang: {k - markdown.TOKENS_KEPT} more") for t, k in seen.items() if k > markdown.TOKENS_KEPT]


def _dependencies(rel, kind, text, raw):
    out, seen = [], set()
    found, gaps = requirements.manifest(rel, text) if kind == "dep_manifest" and text else ([], [])
    for name, spec, pinned, line in found:
        if (name.lower(), spec) in seen:
            continue
        seen.add((name.lower(), spec))
        url = spec.startswith("@") or rel.endswith(".json") and requirements.npm_from_source(spec)
        if not pinned:
            out.append(_row(rel, "SXV-016", "install-from-url" if url else "unpinned-dependency", "medium" if url else "low", f"{name} {spec}", line))
    return out + [_row(rel, "", "coverage-note", "low", f"parse analysis coverage is incomplete (requirement_unparsed). {g}") for g in gaps]


def _code(rel, kind, text, raw):
    """Code rules over a script, or over the fenced code of a document (at the lines it stands on)."""
    if not text:
        return []
    if kind in engine.LANGUAGES:
        return [r[1:] for r in engine.code_rows("", rel, engine.LANGUAGES[kind], text)]
    if kind not in markdown.KINDS or "```" not in text and "~~~" not in text:
        return []
    return [r[1:] for language, _, code in markdown.code_units(rel, text) for r in engine.code_rows("", rel, language, code)]


_PASS = (("forensics", _forensics), ("grants", _grants), ("hooks", _hooks), ("instruction", _directives), ("metadata", _metadata), ("obfuscation", _characters), ("preproc", _preproc), ("supply_chain", _dependencies), ("code", _code))


# Checks whose findings stand elsewhere in the registry order than the pass that makes them.
_ORDER = {"SXV-005": CHECKS.index("persistence") + 1, "SXV-006": CHECKS.index("hooks") + 1, "SXV-007": CHECKS.index("obfuscation") + 1}


def one_file(pkg: str, rel: str, kind: str, text: str | None, raw: bytes | None) -> list[tuple]:
    """Findings of all parsing checks of one file; each check is isolated from the others."""
    out = []
    for name, check in _PASS:
        order = CHECKS.index(name) + 1
        try:
            out += [(pkg, *r, _ORDER.get(r[1], order)) for r in check(rel or "", kind, text, raw)]
        except Exception as e:
            out.append((pkg, rel, "", "check-error", "high", f"{name} failed: {type(e).__name__}", None, None, order))
    return out


def _understated(found: DataFrame, texts: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` with only those capabilities (SXV-033) that the governing manifest, which allows tools, does not declare."""
    capability = F.col("vector") == "SXV-033"
    governed = graph.governing_manifest(files).where("manifest is not null").withColumnRenamed("rel", "path")
    denied = correlate.declarations(inspect.grants(texts).distinct()).where("state = 'denied'").select("pkg_id", "manifest", "axis", F.lit(True).alias("undeclared"))
    out = found.withColumn("axis", F.when(capability, correlate.axis_of())).join(governed, ["pkg_id", "path"], "left").join(denied, ["pkg_id", "manifest", "axis"], "left").where(~capability | F.col("undeclared"))
    return out.withColumn("message", F.when(capability, F.concat("axis", F.lit(" is not declared by "), "manifest")).otherwise(F.col("message"))).select(*found.columns)


def scan(artifacts: DataFrame, ledger_table: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """All findings with ``check_order``, de-duplicated (the most severe stays).

    The texts are read twice whatever the number of checks: once by all parsing
    checks together, code rules included, and once for credential shapes; scripts are
    read once more for their line lengths and manifests for their grants.  Joins
    and exchanges carry findings, paths and ledger rows only.
    """
    a = artifacts.select("pkg_id", "rel", "kind", "text")
    files = ledger.files(artifacts)
    parsed = inspect._map(artifacts, ["pkg_id", "rel", "kind", "text", "raw"], one_file, FINDING + ", check_order int").distinct()

    # hook targets meet the files of their package in the stream of all findings, so the pass over the texts is not repeated
    hook = F.col("rule") == "hook-target"
    known = files.select("pkg_id", F.col("rel").alias("target")).distinct().withColumn("there", F.lit(True))
    parsed = parsed.withColumn("target", F.when(hook, F.regexp_extract("message", r"^[^:]*: ([\s\S]*)$", 1))).join(known, ["pkg_id", "target"], "left").where(~hook | F.col("there").isNull()).drop("target", "there")
    parsed = parsed.withColumns({
        "vector": F.when(hook, "SXV-012").otherwise(F.col("vector")), "message": F.when(hook, F.regexp_replace("message", r"^([^:]*): [\s\S]*$", "$1: unresolved_external")).otherwise(F.col("message")),
    }).withColumn("rule", F.when(hook, "root-hook-autoexec").otherwise(F.col("rule")))

    lines = detect.secret_findings(a).withColumn("check_order", F.lit(CHECKS.index("supply_chain") + 1))
    large = detect.obfuscated_scripts(a).where("rule is not null")
    large = large.select(
        "pkg_id", "path", F.lit("SXV-044").alias("vector"), "rule", F.when(F.col("rule") == "obfuscated-script", "high").otherwise("medium").alias("severity"), F.concat_ws(" ", F.lit("longest line"), F.col("longest_line").cast("string")).alias("message"),
        F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("int").alias("col_no"), F.lit(CHECKS.index("obfuscation") + 1).alias("check_order"),
    )
    out = _understated(lines.unionByName(parsed), a, files).unionByName(large)
    out = out.unionByName(ledger.coverage_findings(files, ledger_table).withColumn("check_order", F.lit(CHECKS.index("coverage") + 1)))
    if comments is not None:
        hidden = detect.hidden_comments(comments).join(files.select("artifact_id", "pkg_id", "rel").distinct(), "artifact_id")
        out = out.unionByName(
            hidden.select(
                "pkg_id", F.col("rel").alias("path"), F.lit("SXV-027").alias("vector"), F.lit("hidden-html-comment").alias("rule"), F.lit("high").alias("severity"), F.col("shape").alias("message"),
                F.col("line_no").cast("int").alias("line_no"), F.lit(None).cast("int").alias("col_no"), F.lit(CHECKS.index("instruction") + 1).alias("check_order"),
            )
        )
    key = ["pkg_id", "vector", "path", "rule", "message", "line_no", "col_no"]
    return out.groupBy(*key).agg(F.min_by("severity", severity_rank()).alias("severity"), F.min("check_order").alias("check_order")).select(*COLUMNS, "check_order")


def verdicts(found: DataFrame, packages: DataFrame) -> DataFrame:
    """Verdict of every package; one without findings is clean."""
    v = findings.headline(found)
    return packages.select("pkg_id").distinct().join(v, "pkg_id", "left").select("pkg_id", F.coalesce("verdict", F.lit("CLEAN")).alias("verdict"))


