"""Tables that a job writes for itself: lineage is cut there, so a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialised(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names and read from there; in a local run without that setting
    to a new folder. large: packed closer, for tables that grow with the input."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        where = spark.sparkContext.getCheckpointDir()
    path = f"{where.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd" if large else None)
    return spark.read.schema(df.schema).parquet(path)
