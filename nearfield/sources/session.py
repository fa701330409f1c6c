"""What a session needs so that its Python workers find this package."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Puts the folder of the package on the workers' path. On a cluster whose machines don't share that folder, install
    the package there or submit it with --py-files."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder named by spark.checkpoint.dir, which all executors share. Where that is unset a folder of this
    machine serves a local master and no other. It is deleted when the application ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    root = f"{(named or 'file:///tmp/nearfield-shared').rstrip('/')}/nearfield-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{root}/{label}-{uuid.uuid4().hex}"
