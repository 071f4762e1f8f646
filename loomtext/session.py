"""Session set-up and shipping of this package to the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def get_session(master: str = "local[*]", app: str = "loomtext", **conf: str) -> SparkSession:
    """A session with Arrow, adaptive execution and UTC; ``conf`` adds or overrides settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for an application.

    Workers then import it whether or not it is installed there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="loomtext-src-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    tree = os.path.join(out, "tree")
    shutil.copytree(here, os.path.join(tree, os.path.basename(here)), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(out, "loomtext"), "zip", tree))
    shutil.rmtree(tree)
    _shipped.add(sc.applicationId)
