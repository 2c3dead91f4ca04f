"""Operator 5: token counts as rollups that are maintained by deltas.

Totals of documents and tokens by source, language and tokenizer version are sums, so a change of the corpus is a table of
signed rows: an inserted document counts +1 and its tokens, a deleted one -1 and minus its tokens, a revised count is both.
A batch of changes is aggregated to its groups and written to a folder named by the batch; Spark's success marker in it is the commit.
Committing a batch again changes nothing, and a batch whose job was lost is written anew, so retries never count twice; other rows under
a committed name are an error.
Totals are the sums over all committed batches; compact() folds them into one and keeps the names of what it holds.

Null sources and languages are groups of their own. Null and empty texts have 0 tokens and still are documents. Repeated rows
count each, also those without doc_id. A group whose documents and tokens are 0 is not listed. Empty batches commit and change nothing.
Very long texts are counted whole. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import ship

from . import pieces as sentencepieces
from . import tokens
from .shared import shared_dir

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, documents long, tokens long"


def words(text: Column) -> Column:
    """Version words-1: maximal runs of what is no white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pieces(text: Column) -> Column:
    """Version pieces-2: maximal runs of ASCII digits, of other characters that are no white space and no ASCII mark, and single marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+|[^\x20\x09-\x0D!-/0-9:-@\[-`{-~]+|[!-/:-@\[-`{-~]")).cast("long")


def _counted(lengths: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    def tokens_of(text: Column) -> Column:
        ship(SparkSession.active())

        @F.arrow_udf("long")
        def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for own in texts:
                yield pa.array(lengths([x or "" for x in own.to_pylist()]), pa.int64())

        return count(text)

    return tokens_of


def _byte_lengths(texts: list[str]) -> list[int]:
    return [len(ids) for ids in tokens.encode(texts)]


def _piece_lengths(texts: list[str]) -> list[int]:
    own = sentencepieces.vocabulary(tokens.vocabulary_path(sentencepieces.MODEL))
    return [len(ids) // 4 for ids in sentencepieces.encoded(texts, own)]


#: How each version counts a text: two by patterns, which SQL can repeat, and two public vocabularies.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"words-1": words, "pieces-2": pieces, "byte_bpe_50k": _counted(_byte_lengths), "piece_bpe_32k": _counted(_piece_lengths)}


def inserted(docs: DataFrame, version: str, sign: int = 1) -> DataFrame:
    """A signed row for each document; sign -1 for deleted ones."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("documents"), (sign * TOKENIZERS[version](F.col("text"))).alias("tokens"))


def revised(docs: DataFrame, before: str, after: str) -> DataFrame:
    """Documents whose count moves from one tokenizer version to another; the text is read once."""
    both = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(s).cast("long").alias("documents"), (s * TOKENIZERS[v](F.col("text"))).alias("tokens")) for v, s in ((before, -1), (after, 1))))
    return docs.select("source", "lang", F.explode(both).alias("x")).select("source", "lang", "x.version", "x.documents", "x.tokens")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


def _digest(sums: DataFrame) -> tuple:
    return tuple(sums.agg(F.count("*"), F.sum(F.xxhash64(*sums.columns).cast("decimal(38,0)"))).first())


class Rollup:
    """The batches in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _committed(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}/_SUCCESS"))

    def batches(self) -> list[str]:
        """The folders of committed batches that totals are summed over."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        done = [n for n in names if self._committed(n)]
        base = max((n for n in done if n.startswith("base=")), default=None)
        folded = {r[0] for r in self.spark.read.parquet(f"{self.folder}/{base.replace('base=', 'held=')}").collect()} if base else set()
        return [n for n in done if n == base or (n.startswith("batch=") and n not in folded)]

    def known(self, batch: str) -> bool:
        name = f"batch={batch}"
        held = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))] if self._fs.exists(self._path(self.folder)) else []
        latest = max((n for n in held if n.startswith("held=") and self._committed(n.replace("held=", "base="))), default=None)
        return self._committed(name) or bool(latest and self.spark.read.parquet(f"{self.folder}/{latest}").where(F.col("name") == name).count())

    def commit(self, batch: str, rows: DataFrame, verify: bool = True) -> bool:
        """Adds a batch of signed rows; False if it was already there. verify: if it was, its rows are worked out and must sum to the same; without it, the name alone counts."""
        if self.known(batch):
            if verify and _digest(_summed(rows.select(*KEYS, "documents", "tokens"))) != _digest(self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/batch={batch}")):
                raise ValueError(f"batch {batch} was committed with other rows")
            return False
        _summed(rows.select(*KEYS, "documents", "tokens")).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/{n}" for n in names))
        return _summed(rows).where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds all batches into one: first the names it holds, then its sums, whose marker makes it count."""
        names = self.batches()
        level = max([int(n[5:]) for n in names if n.startswith("base=")], default=0) + 1
        base = f"{level:09d}"
        old = [n for n in names if n.startswith("base=")]
        held = {n for n in names if n.startswith("batch=")} | ({r[0] for r in self.spark.read.parquet(f"{self.folder}/{old[0].replace('base=', 'held=')}").collect()} if old else set())
        self.spark.createDataFrame([(n,) for n in sorted(held)], "name string").write.mode("overwrite").parquet(f"{self.folder}/held={base}")
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/base={base}")


def maintained(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """A corpus's life in three batches: all documents come in; those of even doc_id are counted anew by the next version; every fifth is deleted.

    The batches are committed twice, as a driver that lost its connection would; the totals don't change.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, folder or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    even, fifth = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)), F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    gone = docs.where(fifth)
    for _ in range(2):
        rollup.commit("0-load", inserted(docs, "words-1"), verify=False)
        rollup.commit("1-revise", revised(docs.where(even), "words-1", "pieces-2"), verify=False)
        rollup.commit("2-delete", inserted(gone.where(~even), "words-1", -1).union(inserted(gone.where(even), "pieces-2", -1)), verify=False)
    return rollup.totals()
