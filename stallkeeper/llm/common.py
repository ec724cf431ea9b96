"""Helpers that several operators share: written tables, and joins that keep rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
HOT = 1000  # a key that more than one in so many rows have is hot: there are fewer than HOT of these


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset in a local run.
    On a cluster it has to be set: a driver's own folder isn't there for executors."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it from there, so lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "n", how: str = "left") -> DataFrame:
    """rows joined (left or inner) to groups, a row per key, whose column n says how many of the rows have the key.

    Hot keys, of which there are fewer than HOT whatever the input, are joined by broadcast, so the rows of one key never
    meet in one task; the others are joined by shuffle. Both tables are read twice and should be written ones. Column n
    stays in the result; rows whose key is null are kept by a left join only."""
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT > total
    often = F.broadcast(groups.where(hot))
    rest = rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti").join(groups.where(~hot), keys, how)
    return rows.join(often, keys).unionByName(rest)


def unused(name: str, *tables: DataFrame) -> str:
    """name, or with underscores in front until no table has a column of that name."""
    while any(name.lower() == c.lower() for t in tables for c in t.columns):
        name = "_" + name
    return name


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, after which Python workers get BATCH_ROWS rows at a time at most: texts are long, and a worker holds a batch in
    several forms at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return docs
