"""Session helpers: cutting lineage in a folder that every executor can reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` decides. Where it is unset, a temporary folder is
    taken in local mode only; on a cluster that is an error, as a folder of one
    machine can't be read by the others.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(*frames: DataFrame | list[str]) -> str:
    """The start of column names that no column of ``frames`` has, whatever its case."""
    taken = [c.lower() for f in frames for c in (f if isinstance(f, list) else f.columns)]
    name = "__own_"
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name
