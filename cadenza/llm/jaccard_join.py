"""Operator 9: n-gram Jaccard join, size-aware: heavy (large) and light (small) sets are joined in different ways.

A document's set holds its distinct word shingles. Two documents link when their sets' Jaccard similarity is at least the
threshold, and the result gives the component of each document under these links. Every link between different texts counts.

1. Statistics: one scan counts the documents of every shingle in hashed bins, over the whole corpus, and the set sizes.
   Bins only order shingles from rare to frequent; any order gives the same links.
2. Boundary: from the sizes, the cost of enumerating the subsets of light sets is set against scanning inverted lists.
3. Signatures: a light set of n gives, for each size m that a partner may have and that is light too, its subsets of as many
   shingles as a linked pair must share; two sets of these sizes that share a subset link. A heavy set
   (or a light one that may link to a heavy one) goes to the inverted lists of its rarest shingles: n - ceil(t n) + s(n) of
   them with s(n) = 1 + n // 16, so that a linked pair shares at least min(s(n), s(m)) lists. Equal sets of a task are
   represented by the first of them.
4. Hubs: each set's few smallest hashes say which sets are probably alike. The smallest document that has such a hash is its hub,
   and each document is verified against the two hubs it meets most: a family of copies costs its size, not its square. A light
   set is verified against the smallest one that shares a subset, as keys of subsets are hashes.
   Components of these links follow.
5. Lists: an inverted list matters only if it holds several components. Lists are aggregated to their smallest and
   largest component, so a family's members are one row for each task. Of the lists that hold several, documents in too few of
   them to be linked outside of their component fall away.
6. Families: what is left are families whose members share much, linked or not, so their lists are as long as they are large.
   Each document is compared with one head, the least edited member that it meets, and from there on it is the set of shingles
   in which it differs from the head. What a family has in common is gone from these differences, and two members link only if
   their differences share at least half of what they have beyond the difference that a link allows. Pairs come from the rarest
   of these shared shingles; members near their head have none of them among these unless somebody made the same edits.
   Documents of different heads are counted over their lists, where the members of a list's most frequent head meet the others only.
   After that every pair that can be linked is verified or connected, so no link is missed.

Lists and hubs are aggregated before they are shuffled; texts are read again for verifying, and a hub's set is built once for all
that are held against it. Nothing but bins is collected (a fixed size), and tables go through the shared folder.

Null and empty texts, and texts of white space, have empty sets and link with nothing: their component is their own doc_id.
Fewer words than a shingle are one shingle. Very long texts are read whole. Rows with one doc_id are one node. Rows without
doc_id, or with one that is no whole number, link with nothing, and their id and component are null. Empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import release, ship

from .arrays import mix, shingle_sets
from .components import components
from .shared import discard, scratch, small, stored

WIDTH = 5
#: The threshold as a fraction: 75 of 100.
THRESHOLD = (3, 4)
#: Bins of shingle frequencies, and bins in a block of them.
BINS = 1 << 22
BLOCK = 1 << 18
#: Light sets have at most so many shingles.
LIGHT = 8
#: A set of n goes to n // SHARE more lists than one shared list would take.
SHARE = 16
#: Smallest hashes of a set that look for its hub, and hubs that it is verified against.
SKETCH, HUBS = 6, 2
#: Block that holds the counts of set sizes.
_SIZES = -1
#: Equal sets that a task remembers.
_SEEN = 1 << 18


def ceil_part(n: int, t: tuple[int, int] = THRESHOLD) -> int:
    return -(-n * t[0] // t[1])


def overlap(a: int, b: int, t: tuple[int, int] = THRESHOLD) -> int:
    """The fewest shingles that linked sets of a and b share."""
    return -(-t[0] * (a + b) // (t[0] + t[1]))


def shared_lists(n: int) -> int:
    """Of two linked sets, the smaller one's value of this is the fewest lists that they share."""
    return 1 + n // SHARE


def _binned(width: int, bins: int, block: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(bins, np.uint32), np.zeros(4 * LIGHT, np.uint32)
        shift = np.uint64(64 - bins.bit_length() + 1)
        held, n = [], 0

        def add():
            if held:  # distinct bins are few against all, so no array of all is made
                at, n = np.unique((np.concatenate(held) >> shift).astype(np.int32), return_counts=True)
                counts[at] += n.astype(np.uint32)
                held.clear()

        for batch in batches:
            for own in shingle_sets(batch.column(0), width):
                if len(own) < len(sizes):
                    sizes[len(own)] += 1
                held.append(own)
                n += len(own)
                if n >= 1 << 19:
                    add()
                    n = 0
        add()
        part = TaskContext.get().partitionId()
        blocks, blobs = [_SIZES], [sizes.tobytes()]
        for k in range(bins // block):
            if (own := counts[k * block : (k + 1) * block]).any():
                blocks.append(k)
                blobs.append(_packed(own))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([part % 16] * len(blocks), pa.int32()), pa.array(blobs, pa.binary())], ["block", "part", "counts"])
        del counts, held, blobs
        release()

    return task


def _packed(counts: np.ndarray) -> bytes:
    """Counts as they are, or where most are zero as positions and counts; the length tells which."""
    at = np.flatnonzero(counts)
    if 8 * len(at) + 8 < counts.nbytes:
        return np.concatenate([at.astype(np.uint32), counts[at]]).tobytes()
    return counts.tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    own = np.frombuffer(blob, np.uint32)
    if len(own) == n:
        return own
    out = np.zeros(n, np.uint32)
    out[own[: len(own) // 2]] = own[len(own) // 2 :]
    return out


def _summed(block: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                own = _unpacked(blob.as_py(), 4 * LIGHT if k == _SIZES else block)
                sums[k] = sums[k] + own if k in sums else own.astype(np.uint64)
        blobs = [_packed(np.minimum(v, 0xFFFFFFFF).astype(np.uint32)) if k != _SIZES else np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes() for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array(blobs, pa.binary())], ["block", "part", "counts"])

    return task


def frequencies(texts: DataFrame, width: int = WIDTH, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(level of each bin, number of sets by size): levels rise with the logarithm of a bin's count over the mean, 0 up to it."""
    block = min(bins, BLOCK)
    schema = "block int, part int, counts binary"
    rows = texts.select("text").mapInArrow(_binned(width, bins, block), schema)
    rows = rows.repartition("block", "part").mapInArrow(_summed(block), schema)
    rows = rows.repartition("block").mapInArrow(_summed(block), schema).collect()  # bins // block + 1 blobs
    counts, sizes = np.zeros(bins, np.uint32), np.zeros(4 * LIGHT, np.uint32)
    for r in rows:
        if r["block"] == _SIZES:
            sizes = np.frombuffer(r["counts"], np.uint32)
        else:
            counts[r["block"] * block : (r["block"] + 1) * block] = _unpacked(r["counts"], block)
    mean = max(1.0, float(counts.sum(dtype=np.float64)) / bins)
    spread = mean + 3 * mean**0.5
    levels = np.zeros(bins, np.uint8)
    for k in range(0, bins, block):  # block by block, as the driver's memory is small
        levels[k : k + block] = np.clip(np.ceil(8 * np.log2(np.maximum(counts[k : k + block], 1) / spread)), 0, 127)
    del rows, counts
    release()
    return levels, sizes


def subsets_of(n: int, light: int, t: tuple[int, int] = THRESHOLD) -> int:
    """How many subsets a light set of n enumerates."""
    return sum(comb(n, overlap(min(n, m), max(n, m), t)) for m in range(ceil_part(n, t), min(light, n * t[1] // t[0]) + 1))


def boundary(sizes: np.ndarray, t: tuple[int, int] = THRESHOLD) -> int:
    """The largest size of a light set, 0 to LIGHT, at the least cost: subsets to shuffle, against list entries and set comparisons."""

    def cost(light: int) -> float:
        total = 0.0
        for n in range(1, len(sizes)):
            lists = (n - ceil_part(n, t) + shared_lists(n)) + 2.0 * n  # entries, and what verifying reads
            total += int(sizes[n]) * ((subsets_of(n, light, t) if n <= light else 0) + (lists if n * t[1] // t[0] > light else 0))
        return total

    return min(range(LIGHT + 1), key=lambda k: (cost(k), k))


def prefix(own: np.ndarray, levels: np.ndarray, t: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, first those of rare bins, then by hash, and the place of the last of them in that order; levels is indexed by the top bits."""
    shift = np.uint64(64 - len(levels).bit_length() + 1)
    level = levels[(own >> shift).astype(np.int64)]
    order = np.argsort(level, kind="stable")[: len(own) - ceil_part(len(own), t) + shared_lists(len(own))]
    return own[order], (int(level[order[-1]]) << 56) + (int(own[order[-1]]) >> 8)


def subsets(own: np.ndarray, light: int, t: tuple[int, int] = THRESHOLD) -> tuple[list[int], list[bool]]:
    """The keys of a light set's subsets, each for a pair of sizes, and whether the set is of the smaller size."""
    n, keys, lower = len(own), [], []
    for m in range(ceil_part(n, t), min(light, n * t[1] // t[0]) + 1):
        a, b = min(n, m), max(n, m)
        for part in combinations(range(n), overlap(a, b, t)):
            h = np.array([a * 64 + b], np.uint64)
            for x in own[list(part)]:
                h = mix(h + x)
            keys.append(int(h.view(np.int64)[0]))
            lower.append(n == a)
    return keys, lower


def _signed(width: int, levels, light: int, t: tuple[int, int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        order = levels.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            size, first, lists, last, least, keys, low = [], [], [], [], [], [], []
            for doc, own in zip(ids, shingle_sets(batch.column(1), width), strict=True):
                n = len(own)
                size.append(n)
                mark = xxhash.xxh3_128_digest(own.tobytes())
                known = seen.get(mark) if n else None
                if doc is not None and n and known is None:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen[mark] = doc
                first.append(doc if known is None or doc is None else known)
                new = doc is not None and n and known is None
                rare, place = prefix(own, order, t) if new and n * t[1] // t[0] > light else (None, None)
                lists.append(None if rare is None else rare.view(np.int64))
                last.append(place)
                least.append(own[:SKETCH].view(np.int64) if lists[-1] is not None else None)
                k, s = subsets(own, light, t) if new and n <= light else (None, None)
                keys.append(k)
                low.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(last, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.bool_()))],
                ["doc_id", "n", "first", "lists", "last", "least", "subsets", "lower"],
            )
        seen.clear()
        release()

    return task


def _compared(width: int, made):
    """Takes a, b and their texts, sorted by b, and yields made(rows, for each: a's set, b's, both sorted); the set of a run of equal b is built once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, text, own_b = None, None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for k, (b, own_a) in enumerate(zip(batch.column(1).to_pylist(), shingle_sets(batch.column(2), width), strict=True)):
                if b != hub or not batch.column(3)[k].equals(text):
                    hub, text = b, batch.column(3)[k]
                    (own_b,) = shingle_sets(batch.column(3).slice(k, 1), width)
                both = np.concatenate([own_a, own_b])
                both.sort(kind="stable")
                out.append((own_a, own_b, both))
            yield made(batch, out)
        release()

    return task


def _similar_rows(t: tuple[int, int]):
    def made(batch: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keep = []
        for a, b, both in found:
            common = int((both[1:] == both[:-1]).sum())
            keep.append(t[1] * common >= t[0] * (len(a) + len(b) - common) and common > 0)
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return made


def _differing_rows(batch: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Of both sets a hash, which tells the texts of one doc_id apart, and the size; and the shingles that are in one of them only."""
    rows = []
    for a, b, both in found:
        twice = both[1:] == both[:-1]
        once = np.ones(len(both), bool)
        once[1:] &= ~twice
        once[:-1] &= ~twice
        rows.append((*(xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in (a, b)), len(a), len(b), both[once].view(np.int64)))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int64()))], ["a", "b", "own", "of", "n", "n_head", "differ"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The stored pairs (a, b) with their texts, sorted by b. Texts of a are shuffled to b, once for each pair."""
    hubs = small(stored(pairs.select(F.col("b").alias("hub")).distinct(), "join-hubs"))
    a = texts.join(small(pairs), texts["doc_id"] == pairs["a"]).select("a", "b", F.col("text").alias("text_a"))
    b = texts.join(hubs, texts["doc_id"] == hubs["hub"], "left_semi").select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return a.join(b.hint("merge"), "b").select("a", "b", "text_a", "text_b")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, t: tuple[int, int]) -> DataFrame:
    """Those of the stored pairs (a, b) whose texts' sets are similar enough."""
    return _with_texts(pairs, texts).mapInArrow(_compared(width, _similar_rows(t)), "a long, b long")


def _part_of(rows: DataFrame, parts: DataFrame, column: str = "id") -> DataFrame:
    """rows with the component of their document; a document without links is its own."""
    parts = small(parts).select("node", F.col("component").alias("__part"))
    return rows.join(parts, F.col(column) == F.col("node"), "left").withColumn("component", F.coalesce("__part", column)).drop("node", "__part")


def similar(docs: DataFrame, width: int = WIDTH, t: tuple[int, int] = THRESHOLD, bins: int = BINS) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id."""
    with scratch() as keep:
        return keep(stored(_similar(docs, width, t, bins), "join-result"))


def _similar(docs: DataFrame, width: int, t: tuple[int, int], bins: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.expr("try_cast(doc_id AS long)").alias("doc_id"), "text")
    known = texts.where("doc_id is not null")
    found, sizes = frequencies(texts, width, bins)
    light, levels = boundary(sizes, t), spark.sparkContext.broadcast(found)
    signs = stored(texts.mapInArrow(_signed(width, levels, light, t), "doc_id long, n long, first long, lists array<long>, last long, least array<long>, subsets array<long>, lower array<boolean>"), "join-signs")
    rows = stored(signs.select("doc_id", "n", "first"), "join-rows")

    # light sets: all of a key's sets against its smallest one of the smaller size
    keys = signs.where("subsets is not null").select(F.col("doc_id").alias("id"), F.explode(F.arrays_zip("subsets", "lower")).alias("x")).select("id", F.col("x.subsets").alias("key"), F.col("x.lower").alias("lower"))
    hub = keys.groupBy("key").agg(F.min(F.when(F.col("lower"), F.col("id"))).alias("hub"), F.min("id").alias("low"), F.max("id").alias("top")).where("hub is not null and low < top").select("key", "hub")
    light_pairs = keys.join(hub, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()

    # heavy sets: against the hubs of their smallest hashes
    least = signs.where("least is not null").select(F.col("doc_id").alias("id"), F.explode("least").alias("key"))
    hub = least.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub")
    met = least.join(hub, "key").where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("c"))
    best = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("c"), (-F.col("hub")).alias("hub"))), asc=False), 1, HUBS).alias("x"))  # at most SKETCH of them for an id
    heavy_pairs = best.select(F.col("id").alias("a"), F.explode("x").alias("x")).select("a", (-F.col("x.hub")).alias("b"))
    tried = stored(light_pairs.union(heavy_pairs), "join-pairs")
    links = _linked(tried, known, width, t).union(rows.where("first <> doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    links = stored(links, "join-links")
    parts = stored(components(links), "join-parts")

    # inverted lists that hold several components
    own = _part_of(signs.where("lists is not null").select(F.col("doc_id").alias("id"), "n", "last", "lists"), parts)
    entries = own.select("id", "n", "last", "component", F.posexplode("lists").alias("pos", "key"))
    rest = stored(entries.join(small(stored(_split(entries), "join-split")), "key").select("key", "id", "n", "last", "pos", "component"), "join-rest")
    discard(signs)
    rest = _pruned(rest, t)
    if not rest.isEmpty():
        heads = stored(_headed(rest, t), "join-heads")
        differ = _with_texts(stored(heads.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")), "join-pairs"), known)
        differ = stored(differ.mapInArrow(_compared(width, _differing_rows), "a long, b long, own long, of long, n long, n_head long, differ array<long>"), "join-differ")
        near = F.expr(f"{t[0] + t[1]} * size(differ) <= {t[1] - t[0]} * (n + n_head)")
        differ = differ.withColumn("far", ~near)
        pairs = _pairs_by_difference(_part_of(differ, parts, "a"), t).union(_pairs_of_heads(rest.join(small(heads), "id"), t))
        pairs = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "join-pairs")
        links = links.union(differ.where(near).select("a", "b")).union(_linked(pairs, known, width, t))
        parts = stored(components(links), "join-parts")
    return _part_of(rows.select("doc_id", F.col("n").alias("n_shingles")), parts, "doc_id").select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def _split(entries: DataFrame) -> DataFrame:
    """The keys of lists that hold several components."""
    return entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("top")).where("low < top").select("key")


def _pruned(entries: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Entries of lists that hold several components, of documents that are in enough of them to have a link there; twice over, since each step takes lists from the other."""
    least = 1 + F.floor(F.ceil(F.col("n") * t[0] / t[1]) / SHARE)
    for _ in range(2):
        entries = entries.join(small(stored(_split(entries), "join-split")), "key")
        enough = entries.groupBy("id", "n").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("id", "c")
        entries = stored(entries.drop("c").join(small(stored(enough, "join-enough")), "id").select("key", "id", "n", "last", "pos", "component", "c"), "join-rest")
    return entries


def _lists(n: str, t: tuple[int, int]) -> str:
    """SQL: the lists that a set of n goes to."""
    return f"({n} - ceil({n} * {t[0]} / {t[1]}) + 1 + floor({n} / {SHARE}))"


def _headed(entries: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(id, head): of the lists' heads the one that a document meets most. A list's head is the member with the largest share of its own lists left: the one that has the least of its own."""
    share = F.expr(f"-c / {_lists('n', t)}")
    low = small(stored(entries.groupBy("key").agg(F.min(F.struct(share.alias("share"), "id")).alias("m")).select("key", F.col("m.id").alias("head")), "join-heads"))
    met = entries.join(low, "key").groupBy("id", "head").agg(F.count("*").alias("c"))
    best = met.groupBy("id").agg(F.max(F.struct("c", (-F.col("head")).alias("last"))).alias("m"))
    return best.select("id", (-F.col("m.last")).alias("head"))


def _pairs_by_difference(rows: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs (a > b) of one head, in different components and not both linked to the head, that may link. rows: a, b (its head), own, of, n, n_head, differ, far (not linked to the head), component.

    Two sets differ in as many shingles as are in one of their differences from the head only: d_x + d_y - 2 s, if those share s.
    They link if that is at most n_x + n_y - 2 o, o being the overlap that they need; so s >= (d_x + d_y - n_x - n_y) / 2 + o.
    Two that are linked to the head are connected by it; one of all others at least isn't, and that makes s at least 1. So
    they share one of the first d - s + 1 shingles of both differences, in any order that is the same for all: first those that
    no other component has, then from rare to frequent. The bounds on s that hold for all partners cut the rows before the join.
    """
    whole, part = t[0] + t[1], t[1] - t[0]
    rows = rows.withColumn("d", F.size("differ"))
    least = F.expr(f"case when far then greatest(1, ceil(({whole} * d - {part} * (n + n_head)) / {2 * whole})) else greatest(1, floor(({whole} * d + {part} * (n_head - n)) / {2 * whole}) + 1) end")
    entries = rows.where(F.col("d") >= least).select(F.col("a").alias("id"), "own", "n", "d", "far", "component", least.alias("least"), F.col("b").alias("head"), "of", F.explode("differ").alias("key"))
    entries = stored(entries, "join-entries")
    lists = entries.groupBy("head", "of", "key").agg(F.min("component").alias("low"), F.max("component").alias("top"), F.count("*").alias("many")).where("low < top").select("head", "of", "key", "many")
    left = entries.join(small(stored(lists, "join-split")), ["head", "of", "key"])
    of_id = Window.partitionBy("id", "own", "head", "of")  # at most as many rows as a document and its head have shingles
    left = left.withColumn("pos", F.col("d") - F.count("*").over(of_id) + F.row_number().over(of_id.orderBy("many", "key")) - 1).where("d - pos >= least")
    left = stored(left, "join-rest")
    x = left.where("far").select("head", "of", "key", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "d", "pos", "component")))
    y = left.select("head", "of", "key", *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "d", "pos", "far", "component")))
    need = f"(d_x + d_y - n_x - n_y) / 2 + ceil({t[0]} * (n_x + n_y) / {whole})"
    met = x.join(y, ["head", "of", "key"]).where(f"component_x <> component_y and (not far_y or id_x < id_y) and {t[1]} * least(n_x, n_y) >= {t[0]} * greatest(n_x, n_y) and least(d_x - pos_x, d_y - pos_y) >= {need}")
    return met.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct()


def _pairs_of_heads(entries: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs (a > b) of different heads and components that share enough lists. In a list, the members of its most frequent head meet the others only.

    A linked pair shares o shingles at least, and so at least s lists that are among the first n - o + s of both sets. And of the
    set whose lists end first in the order of shingles, all shared ones that are among its lists are lists of the other too,
    so it has no more shared shingles than those beyond its lists and the c lists that hold several components.
    """
    entries = entries.withColumn("most", F.expr(f"n - {_lists('n', t)} + c"))
    counts = entries.groupBy("key", "head").agg(F.count("*").alias("c"))
    major = counts.groupBy("key").agg(F.max(F.struct("c", "head")).alias("m"), F.count("*").alias("heads")).where("heads > 1").select("key", F.col("m.head").alias("major"))
    entries = stored(entries.join(small(stored(major, "join-split")), "key"), "join-rest")
    x = entries.where("head <> major").select("key", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "last", "most", "pos", "component", "head")))
    y = entries.select("key", *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "last", "most", "pos", "component", "head")), (F.col("head") == F.col("major")).alias("in_major"))
    most = f"case when last_x <= last_y then most_x else most_y end >= ceil({t[0]} * (n_x + n_y) / {t[0] + t[1]})"
    beyond = f"ceil({t[0]} * (n_x + n_y) / {t[0] + t[1]}) - 1 - floor(least(n_x, n_y) / {SHARE})"
    close = x.join(y, "key").where(f"head_x <> head_y and component_x <> component_y and (in_major or id_x < id_y) and {t[1]} * least(n_x, n_y) >= {t[0]} * greatest(n_x, n_y) and least(n_x - pos_x, n_y - pos_y) > {beyond} and {most}")
    met = close.groupBy(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).agg(F.count("*").alias("c"), F.max(F.least("n_x", "n_y")).alias("n"))
    return met.where(F.col("c") >= 1 + F.floor(F.col("n") / SHARE)).select("a", "b")


def kept_rows(docs: DataFrame, width: int = WIDTH, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, or null, with all their columns."""
    with scratch() as keep:
        gone = keep(stored(similar(docs, width, t).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "join-gone"))
    return docs.join(small(gone), F.expr("try_cast(doc_id AS long)") == gone["__gone"], "left_anti")
