"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder of ``spark.checkpoint.dir``, which all executors must share.

    Only a local session, where all is one machine, gets a folder of its own if none is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeweave-checkpoint-"))
    return df.checkpoint(eager=True)
