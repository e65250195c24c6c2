"""Reports of an outside code engine: strict decoding, results mapped back to files, gaps for what it did not cover, evidence and traces."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inspect import _map

MAX_BYTES = 16 << 20
MAX_STEPS = 128
#: Keys of a result that name a place or the run and not the finding.
ENGINE_KEYS = {"fingerprint", "engine_kind", "is_ignored", "validation_state", "metavars", "lines"}
PLACE_KEYS = {"line", "col", "offset", "start", "end", "endLine", "startLine", "startColumn", "endColumn"}


def _unique(pairs: list[tuple]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"key {k!r} twice")
        out[k] = v
    return out


def _number(v: str) -> int | float:
    x = float(v)
    return int(x) if x == int(x) else x


def decode(text: str | None) -> dict:
    """One strict JSON document with ``results`` and ``errors``; whole numbers come out as integers; anything else is a ValueError."""
    if text is None or len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        raise ValueError("no report, or one over the bound")
    doc = json.loads(text, object_pairs_hook=_unique, parse_float=_number, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
    if not isinstance(doc, dict) or not isinstance(doc.get("results"), list) or not isinstance(doc.get("errors", []), list):
        raise ValueError("a report has results and errors")
    return doc


def report_rows(report_id: str, text: str | None) -> list[tuple]:
    """``(report, kind, path, rule, line, column, detail)``: results, and a gap for every entry that cannot be used, error and unread report."""
    try:
        doc = decode(text)
    except (ValueError, RecursionError) as e:
        return [(report_id, "gap", None, "engine-invalid-output", None, None, str(e)[:80])]
    out: list[tuple] = []
    for r in doc["results"]:
        start = r.get("start") if isinstance(r, dict) else None
        rule, path = (r.get("check_id"), r.get("path")) if isinstance(r, dict) else (None, None)
        place = (start.get("line"), start.get("col")) if isinstance(start, dict) else (None, None)
        if not (isinstance(rule, str) and isinstance(path, str) and all(isinstance(x, int) and not isinstance(x, bool) and x >= 1 for x in place)):
            out.append((report_id, "gap", path if isinstance(path, str) else None, "engine-analysis-error", None, None, "a result without rule, path or place"))
        else:
            out.append((report_id, "result", path, rule.rsplit(".", 1)[-1], *place, None))
    out += [(report_id, "gap", e.get("path") if isinstance(e, dict) and isinstance(e.get("path"), str) else None, "engine-analysis-error", None, None, str(e.get("message", "") if isinstance(e, dict) else e)[:80]) for e in doc.get("errors", [])]
    scanned = doc.get("paths", {}).get("scanned", []) if isinstance(doc.get("paths"), dict) else []
    return out + [(report_id, "scanned", p, None, None, None, None) for p in scanned if isinstance(p, str)]


def decoded(reports: DataFrame) -> DataFrame:
    """Rows of the reports ``(report_id, document)``."""
    return _map(reports, ["report_id", "document"], report_rows, "report_id string, entry string, path string, rule string, line_no int, col_no int, detail string")


def unscanned(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Selected targets that a report does not name as scanned."""
    return targets.join(rows.where("entry = 'scanned'").select("report_id", "path"), ["report_id", "path"], "left_anti")


def mapped(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Results with the source file of their target; one of an unknown target is a gap (``engine-unmapped-target``)."""
    met = rows.where("entry = 'result'").join(targets.select("report_id", "path", "source").distinct().withColumn("_there", F.lit(True)), ["report_id", "path"], "left")
    known = F.col("_there").isNotNull()
    return met.select("report_id", F.when(known, "result").otherwise("gap").alias("entry"), F.coalesce("source", "path").alias("path"), F.when(known, F.col("rule")).otherwise("engine-unmapped-target").alias("rule"), "line_no", "col_no")


def comparable(value: object, drop: set[str] = ENGINE_KEYS) -> object:
    """A JSON value without the given keys, at any depth."""
    if isinstance(value, dict):
        return {k: comparable(v, drop) for k, v in value.items() if k not in drop}
    return [comparable(v, drop) for v in value] if isinstance(value, list) else value


def semantic(value: object) -> object:
    """A JSON value without whole numbers that name places, at any depth."""
    if isinstance(value, dict):
        return {k: semantic(v) for k, v in value.items() if not (k in PLACE_KEYS and isinstance(v, int) and not isinstance(v, bool))}
    return [semantic(v) for v in value] if isinstance(value, list) else value


def evidence_digest(text: str) -> str | None:
    """Digest of what a piece of evidence says, without engine keys and places; None if it is no JSON."""
    try:
        value = semantic(comparable(json.loads(text)))
    except (ValueError, RecursionError):
        return None
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()


def code_flow(trace: object) -> list[tuple[str, int, int]] | None:
    """``(path, line, column)`` of the steps of a trace from source to sink; None when a step is malformed or there are more than ``MAX_STEPS`` between."""
    if not isinstance(trace, dict):
        return None
    between = trace.get("intermediate_vars", [])
    steps = [trace.get("taint_source"), *(between if isinstance(between, list) else [None]), trace.get("taint_sink")]
    if len(steps) > MAX_STEPS + 2:
        return None
    out = []
    for s in steps:
        start = s.get("start") if isinstance(s, dict) else None
        place = (s.get("path"), start.get("line"), start.get("col")) if isinstance(start, dict) else None
        if not place or not isinstance(place[0], str) or not all(isinstance(x, int) and not isinstance(x, bool) and x >= 1 for x in place[1:]) or re.match(r"^(?:/|[A-Za-z]:)|(?:^|/)\.\.(?:/|$)", place[0]):
            return None
        out.append(place)
    return out
