"""Cutting long plans with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` without its plan, from the folder that the cluster names in ``spark.checkpoint.dir``.

    A table that several stages read is computed once, and the plans that follow stay small enough to
    analyse. Where the session names no folder a local session gets a temporary one; on a cluster, whose
    executors would not share it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="braidwork-"))
    return df.checkpoint(eager=True)
