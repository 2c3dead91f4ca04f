"""Tables and folders that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two long columns that may be broadcast: at 16 bytes each under 64 MB.
BROADCAST_ROWS = 2_000_000


_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor sees; only where that is unset and all runs on one machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_cadenza_dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="spark-cadenza-")
            spark.sparkContext._cadenza_dir = found
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: it cuts the lineage, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cadenza_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that stored() writes inside, in the end, but for those that the given function was called with."""
    own: list[DataFrame] = []
    _scopes.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not df]
        if len(_scopes) > 1:
            _scopes[-2].append(df)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        for df in own:
            discard(df)


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() has written, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cadenza_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows (counted, so give a stored table); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """name, or with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(column: str, n: int):
    """crc32 of the column's text, modulo n: the fold of a row."""
    return F.crc32(F.col(column).cast("string")) % n
