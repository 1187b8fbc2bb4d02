"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the cluster's shared checkpoint folder.

    The folder is the one ``spark.checkpoint.dir`` names; where that is unset (local tests), a
    temporary one is used. Files go when nothing refers to the frame and the cleaner is on.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spanloom-checkpoint-"))
    return df.checkpoint(eager=True)
