"""Relations that several branches of a plan read, computed once and kept as Parquet.

They go to the folder named by ``spark.checkpoint.dir``, which all executors share; a local
folder is set only where that is unset. Losing an executor then costs nothing but its tasks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    root = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{KEY} must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="loomtext-staging-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set(KEY, root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
