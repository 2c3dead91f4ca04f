"""Sessions, and the way this package reaches Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_HERE = Path(__file__).resolve().parent
#: Bytes of an Arrow batch that goes to or from a Python worker; Spark's own default lets two workers outgrow an executor of 3 GB on long texts.
BATCH_BYTES = 2 << 20


def session(name: str = "cadenza", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; every setting can be given as a keyword with _ for the dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Before Python workers are used: limits their Arrow batches, where the session has Spark's default, and makes this package importable there.

    Nothing is to be done for the latter where PYTHONPATH leads to it, else the package is added once to the session's files.
    """
    context, limit = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(limit, str(BATCH_BYTES))
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(_HERE.parent) in paths or getattr(context, "_cadenza_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-cadenza-")) / "cadenza.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(_HERE.rglob("*.py")):
            out.write(p, p.relative_to(_HERE.parent))
    context.addPyFile(str(archive))
    context._cadenza_shipped = True


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows worked out once and without their plan, in the folder that spark.checkpoint.dir names; only where it is unset and all runs on one machine, in one of our own."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-cadenza-"))
    return rows.checkpoint()


class Workbench:
    """Tables between steps as Parquet in the folder that spark.checkpoint.dir names (where it is unset and all runs on one machine, one of our own): lineage ends there, and losing an executor costs no more than a step."""

    def __init__(self, spark: SparkSession):
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-cadenza-"))
        self.spark, self.folder, self._paths = spark, context.getCheckpointDir(), []

    def path(self, name: str = "table") -> str:
        """A new path in the folder, deleted by clear()."""
        self._paths.append(f"{self.folder}/{name}-{uuid.uuid4().hex}")
        return self._paths[-1]

    def put(self, rows: DataFrame, keep: bool = False) -> DataFrame:
        """rows, worked out once. keep: not deleted by clear()."""
        path = self.path()
        rows.write.parquet(path)
        if keep:
            self._paths.remove(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        """Deletes what put() wrote, once nothing reads it any more."""
        for path in self._paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self._paths = []


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system: the worker lives on beside the JVM, which may need it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
