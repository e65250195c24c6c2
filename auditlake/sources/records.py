"""Records in JSON lines, and reports as one canonical document."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "benchmark_id string, split string, label int, source_name string, attack_categories array<string>, text string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One record a line; a line that is no such record, or a label other than 0 and 1, fails the read."""
    df = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    return df.withColumn("label", F.when(F.assert_true(F.coalesce(F.col("label").isin(0, 1), F.lit(False)), F.lit("label must be 0 or 1")).isNull(), F.col("label")))


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def sarif(findings: DataFrame, tool: str = "auditlake") -> dict:
    """A report document of the findings of one package (bounded by the per-group cap): rules sorted by id, results in finding order."""
    from ..operators.findings import order_columns

    rows = [r.asDict() for r in findings.orderBy(*order_columns()).toLocalIterator()]
    results = []
    for r in rows:
        region = {"region": {"startLine": r["line_no"], **({"startColumn": r["col_no"]} if r["col_no"] else {})}} if r["line_no"] else {}
        results.append({
            "ruleId": r["vector"] or r["rule"], "level": {"critical": "error", "high": "error", "medium": "warning"}.get(r["severity"], "note"), "message": {"text": r["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, **region}}], "properties": {"severity": r["severity"], "rule": r["rule"]},
        })
    rules = [{"id": i} for i in sorted({r["ruleId"] for r in results})]
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}


MAX_REPORT = 64 << 20


def encode(document: dict) -> bytes:
    """Canonical bytes: sorted keys, ASCII, one newline at the end; a document over the bound is refused."""
    out = json.dumps(document, sort_keys=True, ensure_ascii=True, separators=(",", ":")).encode() + b"\n"
    if len(out) > MAX_REPORT:
        raise ValueError("the report is larger than 64 MiB")
    return out


def write_merged(reports: DataFrame, path: str, tool: str = "auditlake") -> int:
    """One document with a run a package, in the order of the packages, streamed row by row; the number of runs.

    ``reports`` has ``pkg_id, report``; packages without a document are left out.
    """
    target = Path(path).resolve()
    handle, name = tempfile.mkstemp(dir=target.parent)
    n = 0
    with os.fdopen(handle, "w", encoding="ascii") as f:
        f.write('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[')
        for pkg, doc in reports.where("report is not null").select("pkg_id", "report").orderBy("pkg_id").toLocalIterator():
            run = {"automationDetails": {"id": pkg}, "results": json.loads(doc)["results"], "tool": {"driver": {"name": tool, "rules": [{"id": r} for r in json.loads(doc)["rules"]]}}}
            f.write(("," if n else "") + json.dumps(run, sort_keys=True, ensure_ascii=True, separators=(",", ":")))
            n += 1
        f.write('],"version":"2.1.0"}\n')
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, target)
    return n


def write_report(document: dict, path: str, outside: str | None = None) -> None:
    """Replace the file at once; refuse a target inside the folder that was read."""
    target = Path(path).resolve()
    if outside and target.is_relative_to(Path(outside).resolve()):
        raise ValueError("the report must not be written into the package")
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "wb") as f:
        f.write(encode(document))
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, target)
