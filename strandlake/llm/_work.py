"""Shared-folder handling: where intermediate tables go so that they survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. A local session without it gets one of its own; on a
    cluster, where no folder of this machine would do, its lack is an error."""
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            there = current.get()
        elif re.fullmatch(r"local(\[.*\])?", context.master):
            there = tempfile.mkdtemp(prefix="strandlake-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(there)
    return there


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def on_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it (clusters: --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), root]))
