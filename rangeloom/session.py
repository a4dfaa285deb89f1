"""What every part of the package needs of a session: workers that can import it, and the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let local Python workers import this package when it is run from a source tree."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one; any other master
    is refused, as its executors would not see each other's files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = f"/tmp/checkpoints/rangeloom-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")
