"""Links between sets that share a key: which classes hang together at a Jaccard similarity.

Callers give keys such that every pair of similar sets shares one (prefix
tokens of a set-similarity join, bands of MinHash).  No list of all pairs
within a key is ever made:

1. stars - each key's members are verified against one leader; keys whose
   members all hang together already are dropped;
2. crowds - in keys where a component has many members, ids outside it are
   verified against a few of them, so a large group isn't compared pair by pair;
3. the rest - sets of different components that still share a key meet in
   size-banded tiles, where the bit counts of hashed bitmaps bound the overlap
   from above; only survivors are verified on their sorted arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.workspace import materialize, sized

#: 64-bit words of a bitmap signature.
WORDS = 16
#: Extra rounds for keys in which one component already has CROWD members, with so many leaders each.
ROUNDS, CROWD, LEADERS = 3, 8, 4
#: An id's keys that its rows carry in tiles, smallest first.
CARRIED = 64


def bitmap(keys: np.ndarray) -> np.ndarray:
    """1024 hashed bits of a set of 64-bit hashes, as 16 longs."""
    bits = np.zeros(WORDS * 64, dtype=np.uint8)
    bits[(keys >> np.uint64(7)) & np.uint64(WORDS * 64 - 1)] = 1
    return np.packbits(bits).view(np.int64)


def wide_bitmap(keys: np.ndarray) -> bytes | None:
    """For sets that would fill the narrow bitmap: a power of two of bits, twice the members at least."""
    if len(keys) <= WORDS * 32:
        return None
    bits = np.zeros(1 << int(2 * len(keys) - 1).bit_length(), dtype=np.uint8)
    bits[(keys >> np.uint64(7)) & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits).tobytes()


def verified(pairs: DataFrame, nodes: DataFrame, arrays_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The (a, b) of pairs whose sets have 100 * intersection >= 75 * union, as a table.

    Sizes and bitmaps come first; arrays are made only for sets of pairs that those leave.
    """
    pairs = materialize(pairs, "pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    asked = nodes.join(sized(ids), "id", "left_semi")
    own = lambda x: asked.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("ref", "n", "sig", "wide")))
    left = pairs.join(own("a"), "a").join(own("b"), "b").where(_may_link("a", "b"))
    left = materialize(left.select("a", "b", "ref_a", "ref_b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(_prune, "a long, b long, ref_a long, ref_b long"), "pairs")
    refs = materialize(left.select(F.explode(F.array("ref_a", "ref_b")).alias("ref")).distinct(), "refs")
    arrays = materialize(arrays_of(refs), "arrays")
    return materialize(
        left.join(arrays.select(F.col("ref").alias("ref_a"), F.col("keys").alias("ka")), "ref_a")
        .join(arrays.select(F.col("ref").alias("ref_b"), F.col("keys").alias("kb")), "ref_b")
        .select("a", "b", "ka", "kb")
        .mapInArrow(_verify, "a long, b long"),
        "links",
    )


def _may_link(a: str, b: str) -> Column:
    """Whether sizes and bit counts leave room for the overlap: the bits that differ are at most as many as the members that do."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    apart = sum((F.bit_count(F.col(f"sig_{a}")[i].bitwiseXOR(F.col(f"sig_{b}")[i])) for i in range(WORDS)), F.lit(0))
    return (100 * F.least(na, nb) >= 75 * F.greatest(na, nb)) & (na + nb >= 7 * apart)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _may_link, over the wide bitmaps of large sets; the wider of two is folded to the other's width."""
    for batch in batches:
        keep = np.ones(batch.num_rows, dtype=bool)
        for i, (na, nb, x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6), batch.column(7), strict=True)):
            if not x.is_valid or not y.is_valid:
                continue
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            width = min(len(x), len(y))
            x, y = (np.bitwise_or.reduce(z.reshape(-1, width), axis=0) for z in (x, y))
            keep[i] = na + nb >= 7 * int(np.bitwise_count(x ^ y).sum())
        yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, ka, kb = batch.columns
        keep = np.zeros(len(a), dtype=bool)
        for i, (x, y) in enumerate(zip(ka, kb, strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            if not len(x) or 100 * len(x) < 75 * len(y):
                continue
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int(np.count_nonzero(y[at] == x))
            keep[i] = 100 * both >= 75 * (len(x) + len(y) - both)
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def connect(postings: DataFrame, nodes: DataFrame, arrays_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """postings (key, id), each pair once -> (id, label) for ids with a link; label: a long shared by what hangs together.

    nodes: one row (id, ref, n, sig, wide) for each id: what arrays_of knows it by, its
    size and its bitmaps.  arrays_of takes a table of distinct refs and returns
    (ref, keys): sorted 64-bit hashes as bytes.
    """
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    every = materialize(postings.join(shared, "key").select("key", "id"), "shared")
    # keys with the same members say the same: one of them stays
    lists = every.groupBy("key").agg(F.bit_xor(F.xxhash64("id")).alias("digest"), F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    multi = materialize(every.join(lists.groupBy("digest", "n", "lo", "hi").agg(F.min("key").alias("key")).select("key"), "key"), "lists")
    lead = multi.groupBy("key").agg(F.min("id").alias("b"))
    links = [verified(multi.join(lead, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), nodes, arrays_of)]
    for turn in range(ROUNDS + 1):
        labels = materialize(components(reduce(DataFrame.union, links)), "labels")
        rest = materialize(_unsettled(multi, labels), "open")
        pairs = _crowds(rest, turn) if turn < ROUNDS else None
        if pairs is None or not (tried := pairs.count()):
            break
        links.append(verified(pairs, nodes, arrays_of))
        if 20 * links[-1].count() < tried:  # what is left seldom belongs to the crowd
            labels = materialize(components(reduce(DataFrame.union, links)), "labels")
            rest = materialize(_unsettled(multi, labels), "open")
            break
    if rest.isEmpty():
        return labels
    links.append(verified(_tiles(rest, nodes), nodes, arrays_of))
    return labels if links[-1].isEmpty() else materialize(components(reduce(DataFrame.union, links)), "labels")


def _crowds(rest: DataFrame, turn: int) -> DataFrame:
    """Pairs for keys in which one component has CROWD members or more: each id outside it with LEADERS of its members."""
    parts = rest.groupBy("key", "label").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD)
    crowd = materialize(parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("x")).select("key", F.col("x.label").alias("crowd")), "crowds")
    rows = rest.join(sized(crowd), "key")
    order = F.xxhash64("id", F.lit(turn))
    lead = rows.where("label = crowd").groupBy("key", F.pmod(order, F.lit(LEADERS)).alias("slot")).agg(F.min(F.struct(order, F.col("id").alias("b"))).alias("x")).select("key", "x.b")
    return materialize(rows.where("label <> crowd").join(lead, "key").select(F.col("id").alias("a"), "b").distinct(), "crowd_pairs")


def _unsettled(multi: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of keys that members of more than one component share."""
    now = multi.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    keys = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return now.join(keys, "key")


def _tiles(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in one key and in the same or neighbouring size band that the bitmaps can't rule out.

    In each key the members of its largest component meet the others only, never each other.
    Two sets that share many keys meet at the smallest one only: each row carries its id's first
    CARRIED keys, and the smallest that two such lists have in common is the smallest of all.
    Pairs whose lists have none in common come from every shared key, and are made one at the end.
    """
    ids = materialize(rows.select("id").distinct(), "ids")
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("members"))
    crowd = sizes.groupBy("key").agg(F.max_by("label", F.struct("members", "label")).alias("crowd"))
    rows = rows.join(crowd, "key").select("key", "id", "label", (F.col("label") == F.col("crowd")).alias("crowd"))
    firsts = rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, CARRIED).alias("firsts"))
    rows = rows.join(nodes.select("id", "n", "sig").join(sized(ids), "id", "left_semi").join(firsts, "id"), "id")
    rows = materialize(rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9)), "tiles")
    of = lambda x, part: part.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "label", "crowd", "n", "sig", "firsts")), (F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))) if x == "a" else F.col("band")).alias("tile"))
    once = F.col("crowd_b") | (F.col("id_a") < F.col("id_b"))
    here = F.coalesce(F.array_min(F.array_intersect("firsts_a", "firsts_b")) == F.col("key"), F.lit(True))
    pairs = of("a", rows.where("not crowd")).join(of("b", rows), ["key", "tile"]).where((F.col("label_a") != F.col("label_b")) & once & _may_link("a", "b") & here)
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
