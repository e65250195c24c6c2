"""The review lane: which files and findings an outside reviewer sees, what is sent, what of a reply counts, and its effect.

The reviewer is a function given by the caller (there is none in this library);
requests are redacted, identified by their digest, bounded by one budget for
all files of a package, and a reply counts only if every part of it can be
checked against the request.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Order of the kinds under review, vectors a review may demote, and the budget of a package.
KIND_ORDER = ("skill_manifest", "agent_identity", "instruction", "doc", "hooks_config", "mcp_config", "agent_config", "plugin_manifest")
DEMOTABLE = ("SXV-028", "SXV-029", "SXV-030", "SXV-031")
MAX_FILES, MAX_CALLS, MAX_INPUT, MAX_REPLY = 25, 25, 1 << 20, 16384
VERDICTS = {"malicious", "benign", "uncertain"}


def targets(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """First files of each package by kind and path: ``pkg_id, rel, kind, target_no``.

    Files are ranked in hashed slices of a package first, so no task orders a whole hot package.
    """
    order = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KIND_ORDER)) + " END")
    some = files.select("pkg_id", "rel", "kind").distinct().withColumn("_o", order).where("_o is not null").withColumn("_s", F.pmod(F.xxhash64("rel"), F.lit(32)))
    first = some.withColumn("_r", F.row_number().over(Window.partitionBy("pkg_id", "_s").orderBy("_o", "rel"))).where(F.col("_r") <= most)
    return first.withColumn("target_no", F.row_number().over(Window.partitionBy("pkg_id").orderBy("_o", "rel"))).where(F.col("target_no") <= most).select("pkg_id", "rel", "kind", "target_no")


@dataclass
class Budget:
    """Calls and bytes left for one package; a reservation that does not fit is refused whole."""

    calls: int = MAX_CALLS
    left: int = MAX_INPUT
    sent: int = 0
    received: int = 0
    refused: int = 0

    def take(self, request: str) -> bool:
        n = len(request.encode("utf-8", "surrogatepass"))
        if self.calls < 1 or n > self.left:
            self.refused += 1
            return False
        self.calls -= 1
        self.left -= n
        self.sent += n
        return True


def eligible(vector: str, coverage: str, text: str | None, provenance: str = "deterministic") -> str | None:
    """Why a finding is not reviewed, or None: the first reason that holds."""
    if vector not in DEMOTABLE:
        return "not-disputable"
    if coverage != "complete":
        return "incomplete"
    if provenance != "deterministic":
        return "not-deterministic"
    return "no-source" if not text else None


def request_of(rule: str, path: str, excerpt: str, redact: Callable[[str], str]) -> tuple[str, str]:
    """Canonical request with the excerpt redacted, and its digest."""
    body = json.dumps({"excerpt": redact(excerpt), "path": path, "rule": rule}, sort_keys=True, ensure_ascii=True, separators=(",", ":"))
    return body, hashlib.sha256(body.encode()).hexdigest()


def reply_verdict(reply: str | None, excerpt: str) -> tuple[str, str | None]:
    """``(verdict, quote)`` of a reply, or what is wrong with it: too long, no strict JSON of the two keys, an unknown verdict, or a quote that the excerpt does not hold."""
    if reply is None:
        return "unavailable", None
    if len(reply.encode("utf-8", "surrogatepass")) > MAX_REPLY:
        return "truncated", None
    try:
        doc = json.loads(reply)
    except (ValueError, RecursionError):
        return "unparseable", None
    if not isinstance(doc, dict) or set(doc) != {"verdict", "quote"} or doc["verdict"] not in VERDICTS or not isinstance(doc["quote"], str):
        return "unparseable", None
    if doc["verdict"] == "malicious" and (not doc["quote"].strip() or doc["quote"] not in excerpt):
        return "inconclusive", None
    return doc["verdict"], doc["quote"]


def judged(candidates: DataFrame, reviewer: Callable[[str], str | None], redact: Callable[[str], str] = lambda s: s) -> DataFrame:
    """Outcome of every candidate (pkg_id, candidate_id, vector, rule, path, coverage, excerpt): eligibility, budget, the reply, and outcomes taken over from the same request.

    Equal requests of a package are one.  The first ``MAX_CALLS`` of them, by the
    least id of their candidates, share the package's budget and are all that is
    gathered in one task; the rest is over the budget.
    """
    request = StructType.fromDDL("body string, digest string")

    @F.pandas_udf(request)
    def requests(rule: pd.Series, path: pd.Series, excerpt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([request_of(*x, redact) for x in zip(rule, path, excerpt)], columns=["body", "digest"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        budget, rows = Budget(), []
        for r in pdf.sort_values("first").itertuples():
            rows.append((r.pkg_id, r.request_digest, *(reply_verdict(reviewer(r.body), r.excerpt) if budget.take(r.body) else ("budget", None))))
        return pd.DataFrame(rows, columns=["pkg_id", "request_digest", "outcome", "quote"])

    vector, text = F.col("vector"), F.col("excerpt")
    why = F.when(~vector.isin(*DEMOTABLE), "not-disputable").when(F.col("coverage") != "complete", "incomplete").when(F.coalesce(text, F.lit("")) == "", "no-source")
    marked = candidates.withColumn("_why", why)
    passed = marked.where("_why is not null").select("pkg_id", "candidate_id", F.col("_why").alias("outcome"), F.lit(None).cast("string").alias("quote"), F.lit(None).cast("string").alias("request_digest"), F.lit(False).alias("reused"))
    asked = marked.where("_why is null").select("pkg_id", "candidate_id", "excerpt", requests("rule", "path", "excerpt").alias("r")).select("pkg_id", "candidate_id", "excerpt", "r.body", F.col("r.digest").alias("request_digest"))
    firsts = asked.groupBy("pkg_id", "request_digest").agg(F.min("candidate_id").alias("first"), F.min_by("body", "candidate_id").alias("body"), F.min_by("excerpt", "candidate_id").alias("excerpt"))
    within = firsts.withColumn("_r", F.row_number().over(Window.partitionBy("pkg_id").orderBy("first"))).where(F.col("_r") <= MAX_CALLS).drop("_r")
    answers = within.groupBy("pkg_id").applyInPandas(one, "pkg_id string, request_digest string, outcome string, quote string")
    met = asked.join(answers, ["pkg_id", "request_digest"], "left").join(firsts.select("pkg_id", "request_digest", "first"), ["pkg_id", "request_digest"])
    outcome = F.coalesce("outcome", F.lit("budget"))
    return passed.unionByName(met.select("pkg_id", "candidate_id", outcome.alias("outcome"), "quote", "request_digest", ((F.col("candidate_id") != F.col("first")) & (outcome != "budget")).alias("reused")))


def applied(results: DataFrame, links: DataFrame, reviews: DataFrame) -> DataFrame:
    """Results with a review of theirs that says benign demoted to low, once a result, only for the vectors that may be demoted."""
    benign = reviews.where("outcome = 'benign'").join(links, ["pkg_id", "candidate_id"]).select("pkg_id", "result_id").distinct().withColumn("_benign", F.lit(True))
    may = F.col("vector").isin(*DEMOTABLE) & (F.col("severity") != "low") & F.coalesce("_benign", F.lit(False))
    return results.join(benign, ["pkg_id", "result_id"], "left").withColumn("effective_severity", F.when(may, "low").otherwise(F.col("severity"))).withColumn("reviewed", may).drop("_benign")


def usage(reviews: DataFrame) -> DataFrame:
    """Totals of the lane: candidates, calls made, outcomes taken over, and refusals of the budget."""
    made = F.col("request_digest").isNotNull() & ~F.col("reused") & (F.col("outcome") != "budget")
    return reviews.agg(F.count("*").alias("candidates"), F.count_if(made).alias("calls"), F.count_if("reused").alias("reused"), F.count_if(F.col("outcome") == "budget").alias("over_budget"))


def audit(reviews: DataFrame, links: DataFrame) -> DataFrame:
    """Reviews by stable ids: result, request and outcome, with the candidates they stand for counted."""
    return reviews.where("request_digest is not null").join(links, ["pkg_id", "candidate_id"]).groupBy("pkg_id", "result_id", "request_digest", "outcome").agg(F.count("*").alias("n_candidates"))


def semantic_findings(texts: DataFrame, reviewer: Callable[[str], str | None], redact: Callable[[str], str] = lambda s: s) -> DataFrame:
    """Advisory findings (SXV-038) on whole files (pkg_id, path, text): medium where the quoted words stand in the file, low where the reviewer is uncertain, a gap where no verdict came.

    The first ``MAX_FILES`` files of a package by path are sent; the others give a gap.
    """
    from .inspect import FINDING

    names = [c.split()[0] for c in FINDING.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        budget, rows = Budget(), []
        for r in pdf.sort_values("path").itertuples():
            body, _ = request_of("semantic-prompt-injection", r.path, r.text, redact)
            verdict, quote = reply_verdict(reviewer(body), r.text) if budget.take(body) else ("budget", None)
            line = r.text[: r.text.index(quote)].count("\n") + 1 if quote and quote in r.text else None
            if verdict in ("malicious", "uncertain"):
                rows.append((r.pkg_id, r.path, "SXV-038", "semantic-prompt-injection", "medium" if verdict == "malicious" else "low", quote or "", line, None))
            elif verdict != "benign":
                rows.append((r.pkg_id, r.path, "", f"review-{verdict}", "low", verdict, None, None))
        return pd.DataFrame(rows, columns=names).astype({"line_no": "Int32", "col_no": "Int32"})

    numbered = texts.where("text is not null and text <> ''").select("pkg_id", "path").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("pkg_id").orderBy("path")))
    none = F.lit(None).cast("int")
    beyond = numbered.where(F.col("_r") > MAX_FILES).select("pkg_id", "path", F.lit("").alias("vector"), F.lit("review-budget").alias("rule"), F.lit("low").alias("severity"), F.lit("budget").alias("message"), none.alias("line_no"), none.alias("col_no"))
    sent = texts.select("pkg_id", "path", "text").join(numbered.where(F.col("_r") <= MAX_FILES).select("pkg_id", "path"), ["pkg_id", "path"], "left_semi").dropDuplicates(["pkg_id", "path"])
    return sent.groupBy("pkg_id").applyInPandas(one, FINDING).unionByName(beyond)
