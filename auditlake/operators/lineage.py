"""Cutting lineage by reliable checkpoints, which outlive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The frame, checkpointed in the folder that the cluster names in spark.checkpoint.dir; a folder of our own only where none is set and the master is local, as in tests."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="auditlake-"))
    return df.checkpoint()
