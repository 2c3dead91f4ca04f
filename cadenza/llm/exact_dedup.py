"""Operator 7: exact deduplication with an extendible-hash index on shared files. DataFrame functions only.

1. Segments: one scan writes an entry per row (key: 64-bit hash of the normalised text, its SHA-256, code points, doc_id)
   into the shared folder.
2. Directory: the number of distinct keys by key prefix says which buckets are overfull. An overfull bucket is split by one
   more bit of the key; where its local depth was the directory's, the directory doubles, as often as the keys need. Copies of one text
   have one key, so splitting never depends on them. There is about one slot for every CAPACITY / 2 keys; the directory is a table in the
   shared folder, and broadcast only where it is small.
3. Owners: entries are aggregated by key and part, then dealt by ranges of (bucket, key), so that each owner task holds whole
   buckets' ranges. In it entries of one key are chained and told apart by their SHA-256. In a chain whose texts differ as they
   are, one text of each kind is read again and the normalised bytes are compared; if they aren't equal, the chain is split by them.
   A group of copies arrives as one row for each part, however large it is.
4. The index (one row for each distinct text) is written to the shared folder and joined to the entries. inserted() puts the
   entries of a later batch into an index: buckets that overflow by it are split, and its texts are told apart from known ones by
   key and SHA-256, as the texts of earlier batches aren't read again.

Null texts count as empty, and all empty texts are one group. Ties go to the smallest doc_id; of rows that have one doc_id and one
text, the first that is read stays, whatever their other columns hold. A null doc_id comes after all others; ids may be of any type that has an order. Very long texts are read whole.
Empty tables give no rows. Only doc_id and text are read; kept_rows() hands on all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, scratch, small, stored

#: Distinct keys that a bucket holds before it is split.
CAPACITY = 1 << 16
#: Bits of the key by which keys are counted first; more where a prefix has more keys than a bucket holds.
PREFIX = 12


def normalised(text: Column) -> Column:
    """Without the characters space and U+0009 to U+000D; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _prefix(key: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def segments(docs: DataFrame, bits: int = 64, batch: int = 0) -> DataFrame:
    """The entries: doc_id, batch, row (a number), raw (hash of the text as it is), key, chain, text_sha256, n_cp, link 0. Written to the shared folder.

    Fewer than 64 bits of key, and then of the digest that chains go by, are for tests of collisions.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("raw"), F.char_length(text).cast("long").alias("n_cp"), normalised(F.col("text")).alias("norm"))
    rows = stored(rows.select("doc_id", F.lit(batch).cast("long").alias("batch"), "row", "raw", "n_cp", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256")), "dedup-segments")
    whole = F.col("text_sha256") if bits == 64 else F.substring("text_sha256", 1, 1)
    return rows.withColumn("key", F.shiftleft(F.shiftrightunsigned("key", 64 - bits), 64 - bits) if bits < 64 else F.col("key")).withColumn("chain", whole).withColumn("link", F.lit(0))


def _by_bytes(docs: DataFrame, entries: DataFrame, found: DataFrame) -> DataFrame | None:
    """entries with link: 0, but where a chain of the index found holds texts of different normalised bytes, the place of the row's own among them. None if no chain does.

    Texts with one hash as they are count as alike; of the others in a chain one row each is read again.
    """
    several = stored(found.where("low < top").select("key", "chain").distinct(), "dedup-several")
    if several.isEmpty():
        return None
    kinds = entries.join(small(several), ["key", "chain"]).groupBy("key", "chain", "raw").agg(F.min(F.struct("row", "doc_id")).alias("one"))
    some = stored(kinds.select("key", "chain", F.col("raw").alias("of"), F.col("one.doc_id").alias("id")), "dedup-kinds")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("raw"), "text").join(small(some), (F.col("raw") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "chain", "raw", normalised(F.col("text")).alias("norm"))
    mixed = stored(texts.groupBy("key", "chain").agg(F.min("norm").alias("low"), F.max("norm").alias("top")).where("low <> top").select("key", "chain"), "dedup-mixed")
    if mixed.isEmpty():
        return None
    place = F.dense_rank().over(Window.partitionBy("key", "chain").orderBy("norm")) - 1  # of one text for each way in which it stands
    links = stored(texts.join(small(mixed), ["key", "chain"]).withColumn("place", place).select("key", "chain", "raw", "place").distinct(), "dedup-links")
    return entries.join(small(links), ["key", "chain", "raw"], "left").withColumn("link", F.coalesce("place", "link")).drop("place")


def directory(counts: DataFrame, capacity: int, bits: int) -> DataFrame:
    """(slot, bucket) for each key prefix of bits bits, from the keys that each one has (slot, n).

    A bucket is the shortest prefix that has no more keys than it may hold, written as its first slot: what is left of one bucket after it was split, and
    the directory doubled, as often as its keys need. The longest prefix of a bucket is the directory's depth.
    """
    at = F.expr(f"shiftright(slot, {bits} - depth)")
    levels = counts.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).select("slot", "n", "depth", at.alias("at"))
    fits = levels.groupBy("depth", "at").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("depth") == bits)).select("depth", "at")
    local = levels.select("slot", "depth", "at").join(fits, ["depth", "at"]).groupBy("slot").agg(F.min("depth").alias("depth"))
    return local.select("slot", F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)").alias("bucket"))


def _slots(keys: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """The prefix's bits and the directory. keys: key, repeated ones too."""
    once, bits = keys.distinct(), PREFIX
    while True:
        counts = stored(once.groupBy(_prefix("key", bits).alias("slot")).agg(F.count("*").alias("n")), "dedup-counts")
        over = (counts.agg(F.max("n")).first()[0] or 0) / capacity
        if over <= 1 or bits >= 63:
            return bits, stored(directory(counts, capacity, bits), "dedup-directory")
        bits = min(63, bits + max(1, math.ceil(math.log2(over))))


_CHAIN = ("key", "chain", "link")


def index(entries: DataFrame, capacity: int = CAPACITY, before: DataFrame | None = None) -> DataFrame:
    """One row for each distinct text: bucket, key, chain, link, group_size, n_cp, keep_id, keep_batch, keep_row, and the smallest and largest hash of its texts as they are (low, top). Written to the shared folder. before: an index that the entries are put into."""
    part = F.pmod(F.coalesce("row", F.lit(0)), F.lit(1024)).alias("part")  # a third of all rows may be one text
    best = F.struct((-F.col("n_cp")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "batch", "row")
    parts = entries.groupBy(*_CHAIN, part).agg(F.count("*").alias("n"), F.min(best).alias("best"), F.min("raw").alias("low"), F.max("raw").alias("top"))
    if before is not None:
        held = F.struct((-F.col("n_cp")).alias("size"), F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("doc_id"), F.col("keep_batch").alias("batch"), F.col("keep_row").alias("row"))
        parts = parts.unionByName(before.select(*_CHAIN, F.lit(0).cast("long").alias("part"), F.col("group_size").alias("n"), held.alias("best"), "low", "top"))
    parts = stored(parts, "dedup-parts")
    bits, slots = _slots(parts.select("key"), capacity)
    owned = parts.withColumn("slot", _prefix("key", bits)).join(small(slots), "slot").repartitionByRange("bucket", "key")
    chains = owned.groupBy("bucket", *_CHAIN).agg(F.sum("n").alias("group_size"), F.min("best").alias("best"), F.min("low").alias("low"), F.max("top").alias("top"))
    return stored(chains.select("bucket", *_CHAIN, "group_size", (-F.col("best.size")).alias("n_cp"), F.col("best.doc_id").alias("keep_id"), F.col("best.batch").alias("keep_batch"), F.col("best.row").alias("keep_row"), "low", "top"), "dedup-index")


def inserted(before: DataFrame, docs: DataFrame, batch: int, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index after a later batch of documents, and for each of their rows what deduplicated() gives: kept is false where an earlier row stays. Batches are numbered upwards."""
    entries = segments(docs, batch=batch)
    linked = _by_bytes(docs, entries, index(entries, capacity))
    entries = entries if linked is None else linked
    after = index(entries, capacity, before)
    return after, _judged(entries, after)


def _judged(entries: DataFrame, found: DataFrame) -> DataFrame:
    return entries.join(found.drop("n_cp", "low", "top"), list(_CHAIN)).withColumn("kept", (F.col("row") == F.col("keep_row")) & (F.col("batch") == F.col("keep_batch")))


def _marked(docs: DataFrame, capacity: int, bits: int = 64) -> DataFrame:
    entries = segments(docs, bits)
    found = index(entries, capacity)
    linked = _by_bytes(docs, entries, found)
    return _judged(entries, found) if linked is None else _judged(linked, index(linked, capacity))


def deduplicated(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256, bucket."""
    with scratch() as keep:
        return keep(stored(_marked(docs, capacity, bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket"), "dedup-result"))


def kept_rows(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Dropped rows are told by doc_id and the hash of the text as it is. They are broadcast where they are few enough;
    else the join is shuffled.
    """
    with scratch() as keep:
        marked = stored(_marked(docs, capacity).select("doc_id", "raw", "kept"), "dedup-marked")
        rows = marked.groupBy("doc_id", "raw").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
        dropped = keep(stored(rows.where(~F.col("kept") | (F.col("n") > 1)), "dedup-gone"))
    gone = small(dropped)
    own = fresh(docs, "raw")
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = lambda other: keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed[own] == other["raw"])
    out = keyed.join(gone, same(gone), "left_anti")
    twice = dropped.where("kept")
    if not twice.isEmpty():  # rows repeated whole, of which one stays
        twice = small(twice)
        out = out.unionByName(keyed.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", own]))
    return out.drop(own)
