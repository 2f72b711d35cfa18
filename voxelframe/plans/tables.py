"""Cutting lineage with tables in the folder that all executors share, and sending this package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, the context's, or in local mode a new temporary one.

    On a cluster executors share no local folder, so there a missing setting is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that their Python finds it wherever they run."""
    context, top = spark.sparkContext, Path(__file__).parents[1]
    if getattr(context, "_voxelframe_sent", False) or not top.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"voxelframe-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    context._voxelframe_sent = True


class Tables:
    """Written tables of one query. `drop` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top = spark, f"{folder(spark)}/voxelframe-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """`df` written as Parquet and read again: computed once, and found again when an executor is lost."""
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.written_at = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
