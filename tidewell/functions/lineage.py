"""Cutting lineage in the shared checkpoint folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the folder that spark.checkpoint.dir names; only a single machine may do without, in a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidewell-")
            atexit.register(shutil.rmtree, named, True)
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)
