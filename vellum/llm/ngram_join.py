"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

Method: shingles are ordered rarest first by a hashed count over the whole
corpus; documents that share a shingle of their prefix are candidates; copies
of one set are one class; classes are linked as in ``setjoin`` - stars around
leaders, then size-banded tiles in which bit counts of bitmap signatures bound
the overlap before the sorted arrays are intersected.  Exact up to collisions
of 64-bit hashes.

Defined cases: a null or blank text has an empty set and links with nothing;
1 to 4 words are one shingle; rows with equal sets hang together, whatever
their ids; repeated rows each give a row; a null doc_id gives a row with a null
id that joins like any other, and its component's id is the smallest id that
isn't null (null if there is none).  Very long texts are hashed whole, in parts
of bounded size.  Other columns of the input play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import wordhash
from vellum.llm.setjoin import bitmap, connect, wide_bitmap
from vellum.llm.workspace import bounded_batches, materialize, sized

#: Counters of the rarity sketch: 2 to this power, whatever the corpus.
SKETCH_BITS = 22
#: Parts of a sketch that are added up apart, and sketches that one task adds up at most.
_BLOCKS, _FAN = 64, 32
_CLASS_SHIFT = np.uint64(60)
#: What stands for a missing id where rows are looked up.
_NO_ID = -(2**63)


def rarity(docs: DataFrame) -> np.ndarray:
    """Rarity class, 0 (rare) to 15, of each of 2^SKETCH_BITS shingle buckets.

    Counts cover every shingle of every document.  A bucket is of class 0 while
    its count is what chance puts there; what reaches the driver has one size
    for all corpora (at most 32 MB).
    """
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.uint32)
        for batch in batches:
            for c in wordhash.chunks(batch.column(0)):
                h, _, _ = wordhash.shingles(c)
                np.add.at(total, (h & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
        part = np.full(_BLOCKS, TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BLOCKS, dtype=np.int32)), pa.array(part), pa.array([_packed(b) for b in np.split(total, _BLOCKS)], pa.binary())], names=["block", "part", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(size // _BLOCKS, np.uint64)
        for raw in table.column("counts"):
            total += _unpacked(raw.as_py())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([_packed(total)], pa.binary())})

    schema = "block int, part long, counts binary"
    texts = docs.select("text")
    parts, left = texts.mapInArrow(count, schema), texts.rdd.getNumPartitions()
    for _ in range(max(1, math.ceil(math.log(max(left, 2), _FAN)))):  # a tree: no task adds up more than _FAN parts of 512 KB
        parts = parts.groupBy("block", F.floor(F.col("part") / _FAN).alias("fan")).applyInArrow(add, schema)
    total = np.zeros((_BLOCKS, size // _BLOCKS), np.uint64)
    for row in parts.collect():  # _BLOCKS rows
        total[row.block] += _unpacked(row.counts).astype(np.uint64)
    mean = float(total.sum()) / size
    out = np.empty(total.shape, np.uint8)
    for own, counts in zip(out, total, strict=True):  # a block at a time, so the driver holds one sketch
        excess = (counts - mean) / (6 * np.sqrt(mean) + 8)
        own[:] = np.clip(np.floor(np.log2(np.maximum(excess, 0.5))) + 1, 0, 15)
    return out.reshape(-1)


def _packed(counts: np.ndarray) -> bytes:
    return counts.dtype.char.encode() + zlib.compress(counts.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), raw[:1].decode())


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


def _sets(column: pa.Array, classes: np.ndarray) -> Iterator[np.ndarray]:
    """For each row its distinct shingles, rarest first: class in the top bits, hash below."""
    mask = np.uint64(len(classes) - 1)
    for c in wordhash.chunks(column):
        h, _, at = wordhash.shingles(c)
        keys = (classes[h & mask].astype(np.uint64) << _CLASS_SHIFT) | (h >> np.uint64(4))
        for i in range(c.rows):
            own = np.sort(keys[at[i] : at[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield own


def set_id(keys: np.ndarray) -> int:
    """One long for a set."""
    return int(np.add.reduce(wordhash.mix(keys)).view(np.int64)) if len(keys) else 0


def shingle_sets(docs: DataFrame, kept: Broadcast) -> DataFrame:
    """docs(doc_id, text, spot) -> doc_id, spot, n, cid (of the set; null for the empty one), prefix, sig, wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cid, prefix, sig, wide = [], [], [], [], []
            for keys in _sets(batch.column(1), kept.value):
                n.append(len(keys))
                cid.append(set_id(keys) if len(keys) else None)
                prefix.append(keys[: prefix_length(len(keys))].view(np.int64))
                sig.append(bitmap(keys))
                wide.append(wide_bitmap(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), _lists(prefix), _lists(sig), pa.array(wide, pa.binary())], names=["doc_id", "spot", "n", "cid", "prefix", "sig", "wide"])

    return docs.select("doc_id", "text", "spot").mapInArrow(run, "doc_id long, spot struct<d: bigint, h: bigint>, n long, cid long, prefix array<long>, sig array<long>, wide binary")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def set_arrays(docs: DataFrame, kept: Broadcast) -> DataFrame:
    """ref (cid of the set), keys; for documents with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(set_id(k), k.tobytes()) for k in _sets(batch.column(0), kept.value) if len(k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["ref", "keys"])

    return docs.select("text").mapInArrow(run, "ref long, keys binary")


def ngram_components(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id: one row per input row.

    component_id: the smallest doc_id that links reach.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("spot", F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.xxhash64("text").alias("h")))
    classes = docs.sparkSession.sparkContext.broadcast(rarity(docs))  # 4 MB
    sets = materialize(shingle_sets(docs, classes).withColumn("row", F.monotonically_increasing_id()), "sets")
    # one row stands for each distinct set; its place in the table is the set's id in the join
    known = sets.where("cid is not null")
    chosen = materialize(known.groupBy("cid").agg(F.min("row").alias("row")), "chosen")
    again = known.select("row", "cid").join(chosen.withColumnRenamed("row", "kept"), "cid").where("row <> kept").select("row")
    first = known.join(sized(materialize(again, "again")), "row", "left_anti")
    nodes = first.select(F.col("row").alias("id"), F.col("cid").alias("ref"), "n", "sig", "wide")

    def arrays_of(refs: DataFrame) -> DataFrame:
        spots = first.select("spot", F.col("cid").alias("ref")).join(refs, "ref", "left_semi").select("spot.*").distinct()
        held = docs.select("text", "spot.*").join(sized(materialize(spots, "spots")), ["d", "h"], "left_semi")
        return set_arrays(held, classes).dropDuplicates(["ref"])  # rows that are alike in id and text give one set each

    labels = connect(first.select(F.explode("prefix").alias("key"), F.col("row").alias("id")), nodes, arrays_of)
    by_set = chosen.join(labels.select(F.col("id").alias("row"), "label"), "row", "left").select("cid", F.coalesce("label", "row").alias("label"))
    member = materialize(sets.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(by_set, "cid", "left"), "members")
    classes.destroy()
    named = member.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return member.join(named, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
