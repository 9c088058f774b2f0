"""Python workers of a local session find the package where the driver has it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def on_workers(spark: SparkSession) -> None:
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), root]))
