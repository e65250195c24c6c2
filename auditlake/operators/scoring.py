"""Verdicts of scanned records against their labels.

``rows`` has one record a row: benchmark_id, split, label, source_name,
attack_categories, error, oversize, ledger_skipped.  ``hits`` has its findings:
benchmark_id, vector, rule, severity, tier.  Flags are summed per record before
they meet the records, so the join has one row a record on either side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIEWS = ("blocking", "high_any_tier", "medium_any_tier", "any_finding")
LLM_FAILED = ("llm-error", "llm-unavailable", "llm-budget", "llm-unparseable", "llm-inconclusive")


def flags(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows with the four verdict flags and ``incomplete``."""
    real, high = F.col("vector") != "", F.col("severity").isin("critical", "high")
    per = hits.groupBy("benchmark_id").agg(
        F.bool_or(real & high & F.coalesce(F.col("tier").isin("T1", "T2"), F.lit(False))).alias("blocking"),
        F.bool_or(real & high).alias("high_any_tier"),
        F.bool_or(real & (high | (F.col("severity") == "medium"))).alias("medium_any_tier"),
        F.bool_or(real).alias("any_finding"),
        F.bool_or(~real & (high | F.col("rule").isin(*LLM_FAILED))).alias("gap"),
    )
    out = rows.join(per, "benchmark_id", "left").na.fill(False, [*VIEWS, "gap"])
    return out.withColumn("incomplete", F.col("error").isNotNull() | F.col("oversize") | (F.col("ledger_skipped") != 0) | F.col("gap"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(flagged: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """Confusion matrix of each view; benign records that were not fully scanned and not flagged count in neither FP nor TN."""
    long = flagged.select("label", "incomplete", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("hit")) for v in views])).alias("v")).select("label", "incomplete", "v.view", "v.hit")
    bad = F.col("label") == 1
    n = long.groupBy("view").agg(
        F.count_if(bad & F.col("hit")).alias("tp"), F.count_if(~bad & F.col("hit")).alias("fp"), F.count_if(bad & ~F.col("hit")).alias("fn"),
        F.count_if(~bad & ~F.col("hit") & ~F.col("incomplete")).alias("tn"), F.count_if(~bad & ~F.col("hit") & F.col("incomplete")).alias("unanalyzed"),
    )
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return n.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def most_common(df: DataFrame, key: str, k: int = 0) -> DataFrame:
    """Counts by key, most frequent first, ties by key; ``k`` > 0 keeps the first k."""
    out = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key))
    return out.limit(k) if k else out


def false_positives(flagged: DataFrame, hits: DataFrame) -> DataFrame:
    """Vectors, rules and sources of benign records flagged blocking, each once a record: ``attribute, value, n``."""
    fp = flagged.where((F.col("label") == 0) & F.col("blocking")).select("benchmark_id", "source_name")
    strong = hits.where((F.col("vector") != "") & F.col("severity").isin("critical", "high") & F.col("tier").isin("T1", "T2")).join(fp, "benchmark_id", "left_semi")
    vectors = strong.select("benchmark_id", F.lit("vector").alias("attribute"), F.col("vector").alias("value"))
    rules = strong.select("benchmark_id", F.lit("rule").alias("attribute"), F.concat_ws(" / ", "vector", "rule").alias("value"))
    sources = fp.select("benchmark_id", F.lit("source").alias("attribute"), F.col("source_name").alias("value"))
    return vectors.unionByName(rules).unionByName(sources).distinct().groupBy("attribute", "value").agg(F.count("*").alias("n"))


def recall_by_category(flagged: DataFrame) -> DataFrame:
    """Malicious records and hits by attack category; records without one are ``(unmapped)``."""
    named = F.when(F.size(F.coalesce("attack_categories", F.array().cast("array<string>"))) > 0, F.col("attack_categories")).otherwise(F.array(F.lit("(unmapped)")))
    rows = flagged.where("label = 1").select("benchmark_id", "blocking", F.explode(F.array_distinct(named)).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("total"), F.count_if("blocking").alias("hit")).withColumn("recall", ratio(F.col("hit"), F.col("total")))


def missed_by_source(flagged: DataFrame) -> DataFrame:
    return flagged.where((F.col("label") == 1) & ~F.col("blocking")).groupBy("source_name").agg(F.count("*").alias("missed"))


def vector_hits(flagged: DataFrame, hits: DataFrame) -> DataFrame:
    """Records in which each vector occurs, malicious and benign."""
    once = hits.where("vector <> ''").select("benchmark_id", "vector").distinct().join(flagged.select("benchmark_id", "label"), "benchmark_id")
    return once.groupBy("vector").agg(F.count_if(F.col("label") == 1).alias("malicious"), F.count_if(F.col("label") == 0).alias("benign"))


def error_kind(error: Column) -> Column:
    """Text of an error before its first colon; only its first word if a path follows."""
    head = F.substring_index(error, ": ", 1)
    return F.when(head.contains("/"), F.substring_index(head, " ", 1)).otherwise(head)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Transitions of the blocking verdict from one run to the next; a record only one run has counts as one-sided."""
    b = before.select("benchmark_id", F.col("label"), F.col("blocking").alias("was"))
    a = after.select("benchmark_id", F.col("label").alias("label_after"), F.col("blocking").alias("now"))
    both = b.join(a, "benchmark_id", "full").withColumn("label", F.coalesce("label", "label_after"))
    bad, paired = F.col("label") == 1, F.col("was").isNotNull() & F.col("now").isNotNull()
    return both.agg(
        F.count_if(paired & bad & ~F.col("was") & F.col("now")).alias("new_tp"), F.count_if(paired & bad & F.col("was") & ~F.col("now")).alias("lost_tp"),
        F.count_if(paired & ~bad & ~F.col("was") & F.col("now")).alias("new_fp"), F.count_if(paired & ~bad & F.col("was") & ~F.col("now")).alias("fixed_fp"),
        F.count_if(~paired).alias("one_sided"),
    )


def false_positive_vectors(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of false-positive vectors in two runs over the union of their keys, missing as 0 (inputs of ``false_positives``)."""
    pick = lambda df, n: df.where("attribute = 'vector'").select(F.col("value").alias("vector"), F.col("n").alias(n))
    return pick(before, "n_before").join(pick(after, "n_after"), "vector", "full").na.fill(0, ["n_before", "n_after"])


def split_digest(records: DataFrame, pins: dict[str, str] | None = None) -> DataFrame:
    """sha256 of the sorted distinct ids of each split, joined by newlines, and whether it is the pinned one (null without a pin).

    The ids of a split stream in order through one digest; they are never gathered in a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, split, digest, n = [], None, None, 0
        for batch in batches:
            for s, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or s != split:
                    if digest is not None:
                        done.append((split, digest.hexdigest(), n))
                    split, digest, n = s, hashlib.sha256(), 0
                digest.update(("\n" if n else "").encode() + i.encode())
                n += 1
        if digest is not None:
            done.append((split, digest.hexdigest(), n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.string(), pa.int64()))], ["split", "digest", "n"])

    ids = records.where("benchmark_id is not null").select("split", "benchmark_id").distinct().repartition("split").sortWithinPartitions("split", "benchmark_id")
    out = ids.mapInArrow(run, "split string, digest string, n long")
    pinned = F.expr("CASE split " + " ".join(f"WHEN '{k}' THEN digest = '{v}'" for k, v in pins.items()) + " END") if pins else F.lit(None).cast("boolean")
    return out.withColumn("pinned", pinned)


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of the run before with those of the run after in their place where there are any; an id only the second run has, or another label, is an error row (``error``)."""
    a = after.select(*[F.col(c).alias(f"_{c}") for c in after.columns])
    met = before.join(a, F.col("benchmark_id") == F.col("_benchmark_id"), "full")
    why = F.when(F.col("benchmark_id").isNull(), "only in the second run").when(F.col("_label").isNotNull() & (F.col("_label") != F.col("label")), "labels differ")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) for c in before.columns], why.alias("pair_error"))


def unique_records(records: DataFrame) -> DataFrame:
    """The records, refused with an error when an id stands in rows that differ; exact copies count once."""
    each = records.distinct()
    n = each.groupBy("benchmark_id").agg(F.count("*").alias("_n"))
    checked = each.join(n, "benchmark_id")
    return checked.where(F.assert_true(F.col("_n") == 1, F.concat(F.lit("benchmark_id twice: "), F.col("benchmark_id"))).isNull()).drop("_n")


def markdown_report(views: DataFrame, header: DataFrame) -> DataFrame:
    """Lines of the report of a run: ``section, line``; the tables are small aggregates and stay rows."""
    r = lambda c: F.format_number(c, 4)
    head = header.select(F.lit("header").alias("section"), F.concat_ws(" ", F.lit("records"), "records", F.lit("malicious"), "malicious", F.lit("benign"), "benign").alias("line"))
    rows = views.select(F.lit("views").alias("section"), F.concat(F.lit("| "), F.concat_ws(" | ", "view", "tp", "fp", "fn", "tn", "unanalyzed", r("precision"), r("recall"), r("f1"), r("fpr")), F.lit(" |")).alias("line"))
    return head.unionByName(rows)


def without(hits: DataFrame, vectors: list[str]) -> DataFrame:
    """Findings without those of the named vectors."""
    return hits.where(~F.col("vector").isin(*vectors))


def error_kinds(rows: DataFrame) -> DataFrame:
    """Errors of a run by kind, each with the run's totals: ``records, errors, oversize, kind, n``."""
    total = rows.agg(F.count("*").alias("records"), F.count("error").alias("errors"), F.count_if("oversize").alias("oversize"))
    kinds = rows.where("error is not null").groupBy(error_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))
    return kinds.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").select("records", "errors", "oversize", "kind", "n")
