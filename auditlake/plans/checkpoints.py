"""Where lineage is cut: the folder the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def use_shared_folder(spark: SparkSession) -> None:
    """Set the checkpoint folder to the one named in ``spark.checkpoint.dir``; an own one only in a local session where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint_"))
