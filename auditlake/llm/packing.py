"""Documents of varying length into containers of fixed capacity, by best-fit decreasing.

Sizes are whole numbers of tokens no larger than the capacity, so all that
best-fit decreasing needs to know is how many items there are of each size.
The counts are summed in the cluster; the packing of the counts is computed
once from at most ``capacity`` of them, with a segment tree over remaining
capacities that gives the tightest open container in logarithmic time; and
each item finds its container from its rank among the items of its size.  The
result is that of one best-fit-decreasing run over all documents, yet no task
ever sees more than its share of them.

A document larger than the capacity fills whole containers with its first
pieces; its rest is an item like any other.  Null and empty texts have no
tokens and go into no container.  Ties (equal sizes) are ordered by document
id, so the result depends neither on how the input is partitioned nor on how
much of it there is; repeated document ids are packed as often as they come.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern published with the vocabulary; read from the package beside the file where there is one.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slices that the items of one size are cut into where they meet their plan, so that a size of a third of all items is no hot key.
SLICES = 16


class Tightest:
    """Segment tree over remaining capacities: the least one that is at least ``size`` and has an open container."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.base)

    def set(self, remaining: int, there: bool) -> None:
        i = remaining + self.base
        if self.tree[i] == there:
            return
        self.tree[i] = there
        i >>= 1
        while i:
            now = self.tree[2 * i] | self.tree[2 * i + 1]
            if self.tree[i] == now:
                return
            self.tree[i] = now
            i >>= 1

    def at_least(self, size: int) -> int | None:
        i = size + self.base
        if self.tree[i]:
            return size
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts by size.

    Rows ``(size, first rank, end rank, first container, items a container)``
    and the number of containers.  Containers with one remaining capacity are
    kept as runs of consecutive numbers, so a million equal ones cost one step.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}
    tree = Tightest(capacity)
    used = 0

    def give(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_runs.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, rank = counts[size], 0
        while left:
            remaining = tree.at_least(size)
            if remaining is None:
                remaining, first, n = capacity, used, -(-left // (capacity // size))
                used += n
            else:
                runs = open_runs[remaining]
                first, n = runs.pop()
                if not runs:
                    del open_runs[remaining]
                    tree.set(remaining, False)
            each = remaining // size
            full = min(n, left // each)
            if full:
                rows.append((size, rank, rank + full * each, first, each))
                give(remaining - each * size, first, full)
                rank += full * each
                left -= full * each
            if full < n:
                if left:  # the last items of this size share one container
                    rows.append((size, rank, rank + left, first + full, left))
                    give(remaining - left * size, first + full, 1)
                    full += 1
                    left = 0
                give(remaining, first + full, n - full)
    return rows, used


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``id, n_tokens`` of every row, counted with the vocabulary in ``tokenizer`` (ranks file, read on the driver)."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encode = tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            for part in slices(batch, text_col):
                n = [count_tokens(encode, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, "id long, n_tokens long")


def count_tokens(encode, text: str | None) -> int:
    return len(encode(text)) if text else 0


def ranked(items: DataFrame) -> DataFrame:
    """``items`` (limit_id, size, id) with ``rank``: place by id among the items of one limit and size, from 0.

    Items are cut into ranges of (limit, size, id), so the items of one hot size
    spread over many tasks; each range ranks its own, and the counts of the
    ranges before it (a row a range and size) are added.  The ranges are written
    to the checkpoint folder, so counting and ranking see the same ones.
    """
    cut = items.repartitionByRange("limit_id", "size", "id").withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("limit_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("limit_id", "size", "part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("limit_id", "size", "part").orderBy("id")
    return cut.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["limit_id", "size", "part"]).withColumn("rank", F.col("rank") + F.col("offset")).drop("part", "offset")


def pack(df: DataFrame, limits: list[tuple[int, int]], id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``limit_id, container_id, id, piece_no, first_token, n_tokens`` for every piece of every document and each ``(limit_id, capacity)``.

    Counting tokens is the costly step and is done once; the counts are
    written to the checkpoint folder, so a lost executor costs no recount.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    counted = token_counts(df, id_col, text_col, tokenizer, pattern).where("n_tokens > 0").checkpoint()
    pairs = F.array(*[F.struct(F.lit(i).alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for i, c in limits])
    items = counted.select("id", "n_tokens", F.explode(pairs).alias("l")).select("id", "n_tokens", "l.limit_id", "l.capacity")
    # a document of exactly k capacities has no rest; one that fits is its own rest
    items = items.withColumn("full", F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(F.lit(0)))
    items = items.withColumn("size", F.col("n_tokens") - F.col("full") * F.col("capacity"))
    rest = items.where("size > 0")

    histogram = {(r[0], r[1]): r[2] for r in rest.groupBy("limit_id", "size").count().collect()}  # at most the sum of the capacities
    rows = []
    for limit, capacity in limits:
        got, _ = plan({s: n for (i, s), n in histogram.items() if i == limit}, capacity)
        rows += [(limit, *r) for r in got]
    # a run of the plan is looked up by its last rank among those of its size, in an array sorted by it
    plans = spark.createDataFrame(rows, "limit_id int, size long, lo long, hi long, first long, each long")
    plans = plans.groupBy("limit_id", "size").agg(F.sort_array(F.collect_list(F.struct("hi", "lo", "first", "each"))).alias("runs"))
    plans = plans.select("*", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    rest = ranked(rest).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int"))
    placed = (
        rest.join(plans, ["limit_id", "size", "slice"])
        .withColumn("run", F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0])
        .select(
            "limit_id",
            F.concat(F.lit("b"), (F.col("run.first") + F.floor((F.col("rank") - F.col("run.lo")) / F.col("run.each"))).cast("string")).alias("container_id"),
            F.col("id").alias(id_col),
            F.col("full").cast("int").alias("piece_no"),
            (F.col("full") * F.col("capacity")).alias("first_token"),
            F.col("size").alias("n_tokens"),
        )
    )
    whole = items.where("full > 0").select("limit_id", "capacity", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"))
    whole = whole.select(
        "limit_id",
        F.concat_ws("-", F.lit("d"), F.col("id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"),
        F.col("id").alias(id_col),
        F.col("piece_no").cast("int").alias("piece_no"),
        (F.col("piece_no") * F.col("capacity")).alias("first_token"),
        F.col("capacity").alias("n_tokens"),
    )
    return placed.unionByName(whole)


def fill(packed: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """``limit_id, n_containers, n_tokens, least_containers, unused_share``: how full the containers are, against the bound no packing can beat."""
    capacity = F.create_map(*[F.lit(x) for i, c in limits for x in (i, c)])
    return (
        packed.groupBy("limit_id", "container_id")
        .agg(F.sum("n_tokens").alias("n"))
        .groupBy("limit_id")
        .agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
        .withColumn("least_containers", F.ceil(F.col("n_tokens") / capacity[F.col("limit_id")]))
        .withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * capacity[F.col("limit_id")]))
    )
