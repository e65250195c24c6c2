"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut so that no slice handed to an operator holds more text than this.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a folder of our own only in a local session without one, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint_"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the scan has fewer splits than the cluster has cores.

    Large inputs have more splits than cores and pass through unchanged, so the
    round-robin exchange only ever moves an input that is small for its cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch at row boundaries so that ``column`` has about ``most`` bytes a slice; one longer value is a slice of its own."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    if col.nbytes <= most:
        yield batch
        return
    start = size = 0
    for i, k in enumerate(pc.binary_length(col).to_pylist()):
        k = k or 0
        if size and size + k > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += k
    yield batch.slice(start, n - start)


def map_rows(df: DataFrame, fn: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Run ``fn(*column values of one row) -> iterable of output tuples`` over Arrow batches.

    The loop is over rows of a batch inside one worker call; rows that produce nothing cost no output.
    """
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # as many rows at once as hold about SLICE_BYTES, so that neither values nor output of a whole batch are held
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = [row for args in zip(*(c.to_pylist() for c in part.columns)) for row in fn(*args)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def extension(rel: str = "rel"):
    """Lower-case file extension with its dot, '' if there is none."""
    return F.lower(F.regexp_extract(F.col(rel), r"(\.[A-Za-z0-9]+)$", 1))
