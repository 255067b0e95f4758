"""Cutting the lineage of iterated frames in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, the context's checkpoint folder. Neither on a cluster is an error, since
    a folder of one machine would do for that machine only; in local mode (tests) it is a temporary folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = context._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='sparrowdeck-')}"
        context.setCheckpointDir(found)
    return str(found).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint()
