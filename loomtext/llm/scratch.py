"""Scratch tables and files in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset and all work is done by this machine."""
    root = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{KEY} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set(KEY, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def made() -> list[str]:
    """Paths handed out so far and not yet dropped."""
    return list(_made)


def drop(spark: SparkSession, *paths: str) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in _made:
            _made.remove(name)


def drop_tables(*tables: DataFrame) -> None:
    """Delete what materialised tables read; nothing may read them afterwards."""
    for t in tables:
        drop(t.sparkSession, t.scratch_path)


def release(spark: SparkSession) -> None:
    """Let go of unreachable plans, so that the cleaner deletes the shuffle files of finished stages."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return [next(x for k in range(len(taken) + 1) if (x := f"__{n}{k or ''}") not in taken) for n in names]


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for files that Python workers write."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
