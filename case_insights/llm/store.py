"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a one-process session may do without it (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, unless the session says otherwise: workers hold a batch or two at a time, and texts
    and sets differ in size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's default
        spark.conf.set(key, "8m")


def workers_find_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, if it isn't installed for them."""
    root = str(Path(__file__).parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to shared storage and read again: it cuts the lineage, survives lost
    executors, and costs nothing to read twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``saved`` that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.saved_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    bounded_batches(spark)
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
