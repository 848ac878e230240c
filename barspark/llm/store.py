"""Intermediate tables, written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a new local one if Spark runs in one process, as in tests."""
    folder = spark.conf.get(_CHECKPOINT, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {_CHECKPOINT} to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_CHECKPOINT, folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet to the shared folder and reads it back, with known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(name for k in range(len(taken) + 1) if (name := f"{stem}_{k}") not in taken)
