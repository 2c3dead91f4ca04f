"""A table in versions on a shared file system: writers put whole snapshots, and a version counts from the moment its entry in the log is there.

folder/data/<id> holds a snapshot as Parquet, folder/log/<number> names it. An entry is written aside and then given its name in one step that fails if
another writer has the number: that writer's rows are read and the change is made again on them, so no rows are lost. A writer that dies before
the step leaves the version before; readers of a version go on with its files. Each commit writes the table anew, so it is for ledgers and notes, not for what they are about.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Other writers were first each time."""


class Versions:
    """The table in a folder. Its rows have whatever columns are put; put() adds the versions in which a key came (added) and was last put (updated)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path, self._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def _names(self, part: str) -> list[str]:
        where = self._path(f"{self.folder}/{part}")
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def history(self) -> list[int]:
        """All versions that were ever made, in order. The data of old ones may be gone, see expire()."""
        return sorted(int(n) for n in self._names("log") if n.isdigit())

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self.history(), default=0)

    def _entry(self, version: int) -> dict:
        if not version:
            return {"data": None, "batches": {}}
        stream = self._fs.open(self._path(f"{self.folder}/log/{version:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, or of the newest; None if there is none. A version whose data is gone is an error."""
        version = self.version() if version is None else version
        data = self._entry(version)["data"]
        return None if data is None else self.spark.read.parquet(f"{self.folder}/data/{data}")

    def _publish(self, version: int, entry: dict) -> bool:
        """Whether the version is now this entry's: in one step, and not if there is one already."""
        aside, name = (self._path(f"{self.folder}/log/{n}") for n in (f".{uuid.uuid4().hex}", f"{version:012d}"))
        out = self._fs.create(aside, False)
        out.write(json.dumps(entry).encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename would take another writer's place there, a link doesn't
                os.link(*(unquote(urlparse(self._fs.makeQualified(p).toString()).path) for p in (aside, name)))
            else:
                jvm = self.spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(aside, name, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(aside, False)

    def commit(self, change: Callable[[DataFrame | None, int], DataFrame], batch: tuple[str, int] | None = None, tries: int = 20) -> int:
        """Makes the next version of change(rows of the newest one or None, number of the next one), and returns its number.

        change is called again on newer rows if another writer was first. batch: a stream's name and the number of its batch; a batch that a version already holds changes nothing.
        """
        for _ in range(tries):
            base = self.version()
            entry = self._entry(base)
            if batch and entry["batches"].get(batch[0], -1) >= batch[1]:
                return base
            data = uuid.uuid4().hex
            rows = None if entry["data"] is None else self.spark.read.parquet(f"{self.folder}/data/{entry['data']}")
            change(rows, base + 1).write.parquet(f"{self.folder}/data/{data}")
            batches = {**entry["batches"], **({batch[0]: batch[1]} if batch else {})}
            if self._publish(base + 1, {"data": data, "batches": batches}):
                return base + 1
            self._fs.delete(self._path(f"{self.folder}/data/{data}"), True)
        raise Conflict(f"{self.folder}: {tries} tries")

    def put(self, rows: DataFrame, key: str, order: list[str], batch: tuple[str, int] | None = None) -> int:
        """Puts rows in, in place of those with the same key; of rows with one key the last by order. Rows without a key fall away."""
        names = rows.columns

        def change(before: DataFrame | None, version: int) -> DataFrame:
            new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order, *(c for c in names if c not in order))).alias("r")).select("r.*")
            new = new.select("*", F.lit(version).cast("long").alias("added"), F.lit(version).cast("long").alias("updated"))
            if before is None:
                return new
            both = before.unionByName(new, allowMissingColumns=True)
            columns = [c for c in both.columns if c != "added"]
            last = both.groupBy(key).agg(F.min("added").alias("added"), F.max_by(F.struct(*columns), "updated").alias("r"))
            return last.select(*(F.col("added") if c == "added" else F.col(f"r.{c}").alias(c) for c in both.columns))

        return self.commit(change, batch)

    def sink(self, stream: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: puts each batch of a stream in once, however often Spark gives it."""

        def each(rows: DataFrame, number: int) -> None:
            self.put(rows, key, order, (stream, number))

        return each

    def expire(self, keep: int = 2, older: float = 86_400.0) -> int:
        """Deletes the data of all but the newest versions, and what dead writers left, if it is so many seconds old. Returns how many snapshots went. The log stays, so a number is never given twice."""
        kept = {self._entry(v)["data"] for v in self.history()[-keep:]}
        gone = 0
        for name in self._names("data"):
            where = self._path(f"{self.folder}/data/{name}")
            if name not in kept and self._fs.getFileStatus(where).getModificationTime() <= (time.time() - older) * 1000:
                self._fs.delete(where, True)
                gone += 1
        return gone
