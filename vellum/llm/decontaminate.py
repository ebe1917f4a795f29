"""Benchmark decontamination: passages of test items inside training documents, copied, edited or paraphrased.

Method: every item's word trigrams are seeds, plain and with a gap after the
first or the second word, so that a copy of which every third word is changed
still has some.  One pass counts how often each seed stands in the corpus: those
that no document has go, and of the others an item keeps all but those far more
frequent than its middle one.  A second pass joins document positions to items
by seed hash, gathers hits on nearby diagonals into windows, and scores each
window that has two against its item with Smith-Waterman over words.  A
document is contaminated by an item when the best local alignment reaches
``min_share`` of the score of a full copy.

Items are handled in blocks of bounded size (``BLOCK_ITEMS``), which is all
that is broadcast; a longer benchmark takes more passes.  Hits are expanded to
items for ``MOST_HITS`` at a time, so frequent seeds of long documents are
bounded too; a longer item or document takes memory in proportion to itself.

Defined cases: null or blank documents and items match nothing; items of one
or two words are one seed and need that seed; repeated items and documents each
give rows; of alignments with one score the first in the document counts; a null
doc_id or item_id is carried as null; empty tables give no rows; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import wordhash
from vellum.llm.workspace import bounded_batches, materialize

#: Words of a seed, and its words' places where it has a gap.
SEED = 3
GAPPED = ((0, 1, 3), (0, 2, 3))
#: A seed is too frequent beyond this many times the count of its item's middle seed, and beyond this count.
TIMES, OFTEN = 8, 64
#: Seed hits that are expanded to items at once.
MOST_HITS = 1 << 21
#: Items of which seeds are broadcast at once.
BLOCK_ITEMS = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SHARE = 0.45
_BITS = 22
_U = np.uint64


@dataclass
class Seeds:
    """Sorted seed hashes with the item and position of each, and a bit table that most other hashes fail."""

    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    table: np.ndarray

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions in h whose hash is a seed."""
        maybe = np.flatnonzero(self.table[(h & _U((1 << _BITS) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0]
        at = np.searchsorted(self.hashes, h[maybe])
        at[at == len(self.hashes)] = 0
        return maybe[self.hashes[at] == h[maybe]]


def _seeds(hashes: np.ndarray, item: np.ndarray, at: np.ndarray) -> Seeds:
    order = np.argsort(hashes, kind="stable")
    table = np.zeros(1 << _BITS, dtype=bool)
    table[(hashes & _U((1 << _BITS) - 1)).astype(np.int64)] = True
    return Seeds(hashes[order], item[order], at[order], table)


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for c in wordhash.chunks(pa.array(texts, pa.string())):
        out += [c.words[c.word_at[i] : c.word_at[i + 1]] for i in range(c.rows)]
    return out


def seed_hashes(c: wordhash.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds of a chunk, and the word at which each begins."""
    h, word, _ = wordhash.shingles(c, SEED)
    hashes, words = [h], [word]
    n = len(c.words) - 3
    if n > 0:
        row = np.repeat(np.arange(c.rows), np.diff(c.word_at))
        inside = np.flatnonzero(row[:n] == row[3:])
        for shape, places in enumerate(GAPPED, 1):
            own = sum((c.words[inside + p] * wordhash._STEP[64 + 8 * shape + i] for i, p in enumerate(places)), np.zeros(len(inside), _U))
            hashes.append(wordhash.mix(own))
            words.append(inside)
    return np.concatenate(hashes), np.concatenate(words)


def item_seeds(texts: list[str | None]) -> Seeds:
    hashes, item, at = [], [], []
    first = 0
    for c in wordhash.chunks(pa.array(texts, pa.string())):
        h, word = seed_hashes(c)
        own = np.searchsorted(c.word_at, word, side="right") - 1
        hashes.append(h)
        item.append(own + first)
        at.append(word - c.word_at[own])
        first += c.rows
    if not hashes:
        return _seeds(np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64))
    return _seeds(np.concatenate(hashes), np.concatenate(item), np.concatenate(at))


def rarest(seeds: Seeds, counts: dict[int, int]) -> Seeds:
    """The seeds that the corpus has, but for those of each item that are far more frequent there than its middle one."""
    n = np.array([counts.get(int(h.view(np.int64)), 0) for h in seeds.hashes], np.int64)
    order = np.lexsort((n, seeds.item))
    order = order[n[order] > 0]
    item, n = seeds.item[order], n[order]
    first, size = np.searchsorted(item, item), np.bincount(item)[item] if len(item) else item
    keep = order[n <= np.maximum(TIMES * n[first + size // 2], OFTEN)] if len(item) else order
    return _seeds(seeds.hashes[keep], seeds.item[keep], seeds.at[keep])


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word arrays: score, and the first and past-last word of the window it covers."""
    n, m = len(item), len(window)
    best, end, cols = 0, 0, np.arange(m + 1)
    above, above_from = np.zeros(m + 1, np.int32), cols.copy()
    start = 0
    for i in range(n):
        step = np.where(window == item[i], MATCH, MISMATCH).astype(np.int32)
        row = np.zeros(m + 1, np.int32)
        origin = cols.copy()
        diagonal, down = above[:-1] + step, above[1:] + GAP
        own = np.maximum(diagonal, down)
        row[1:] = np.maximum(own, 0)
        origin[1:] = np.where(own <= 0, cols[1:], np.where(diagonal >= down, above_from[:-1], above_from[1:]))
        # gaps along the row: the largest row[j] - |GAP| * (k - j) over j <= k
        lifted = row - GAP * cols
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, cols, 0))
        row, origin = (top + GAP * cols).astype(np.int32), origin[source]
        j = int(np.argmax(row))
        if row[j] > best:
            best, end, start = int(row[j]), j, int(origin[j])
        above, above_from = row, origin
    return best, start, end


def seed_counts(docs: DataFrame, seeds: Seeds) -> dict[int, int]:
    """How often each seed stands in the whole corpus; at most one row for each seed."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        known = np.unique(s.hashes)
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for c in wordhash.chunks(batch.column(0)):
                h, _ = seed_hashes(c)
                total += np.bincount(np.searchsorted(known, h[s.hits(h)]), minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[seen].view(np.int64)), pa.array(total[seen])], names=["seed", "n"])

    rows = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    found = {r.seed: r.n for r in rows.collect()}  # at most one for each seed of a block
    shared.destroy()
    return found


def _matches(c: wordhash.Chunk, seeds: Seeds, items: list[np.ndarray], min_share: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """row, item, share, first word, words, seed hits: the best alignment of each row with each item that it shares seeds with."""
    h, word = seed_hashes(c)
    hit = seeds.hits(h)
    if not len(hit):
        return
    low, high = np.searchsorted(seeds.hashes, h[hit], side="left"), np.searchsorted(seeds.hashes, h[hit], side="right")
    parts = -(-int((high - low).sum()) // MOST_HITS)
    for part in range(parts):  # some items at a time, each with all its hits
        which, at = _expanded(low, high, word[hit], seeds.item % parts == part if parts > 1 else None)
        yield from _aligned(c, seeds, items, min_share, which, at)


def _expanded(low: np.ndarray, high: np.ndarray, at: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The seeds low..high of each hit, one by one, with the hit's word; only those wanted."""
    ends = np.cumsum(high - low)
    out, first = [], 0
    while first < len(low):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MOST_HITS, side="right")))
        n = high[first:last] - low[first:last]
        which = np.repeat(low[first:last], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(at[first:last], n)
        out.append((which, own) if wanted is None else (which[wanted[which]], own[wanted[which]]))
        first = last
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _aligned(c: wordhash.Chunk, seeds: Seeds, items: list[np.ndarray], min_share: float, which: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, int, int, int]]:
    if not len(which):
        return
    row = np.searchsorted(c.word_at, at, side="right") - 1
    item, diagonal = seeds.item[which], at - seeds.at[which]
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    size = np.array([len(x) for x in items], np.int64)
    slack = np.maximum(size[item] // 2, 4)
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    bounds = np.append(np.flatnonzero(fresh), len(row))
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        r, k = int(row[i]), int(item[i])
        length = int(size[k])
        if j - i < 2 and length > SEED:  # a lone seed of a longer item is chance
            continue
        first = max(int(c.word_at[r]), int(diagonal[i]) - int(slack[i]))
        last = min(int(c.word_at[r + 1]), int(diagonal[j - 1]) + length + int(slack[i]))
        for lo, hi in _pieces(first, last, 4 * length):
            score, a, b = smith_waterman(items[k], c.words[lo:hi])
            share = score / (MATCH * length)
            if share >= min_share and share > best.get((r, k), (0.0,))[0]:
                best[r, k] = (share, lo + a - int(c.word_at[r]), b - a, int(j - i))
    for (r, k), found in sorted(best.items()):
        yield (r, k, *found)


def _pieces(first: int, last: int, most: int) -> Iterator[tuple[int, int]]:
    """A window in overlapping pieces of bounded size, so repeats of a passage don't make one alignment long."""
    most = max(most, 16)
    at = first
    while True:
        yield at, min(at + most, last)
        if at + most >= last:
            return
        at += most // 2


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, share, first_word, n_words, seed_hits.

    One row for each document and item whose best local alignment has at least
    min_share of the score of a full copy; words are counted from 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = materialize(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("place", F.monotonically_increasing_id()), "items")
    out: DataFrame | None = None
    after = -1
    while block := items.where(F.col("place") > after).orderBy("place").limit(BLOCK_ITEMS).collect():
        after = block[-1].place
        texts = [r.text for r in block]
        every = item_seeds(texts)
        seeds = rarest(every, seed_counts(docs, every))
        shared = spark.sparkContext.broadcast((seeds, item_words(texts), [r.item_id for r in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, words, names = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[c.first + r], names[k], *rest) for c in wordhash.chunks(batch.column(1)) for r, k, *rest in _matches(c, own, words, min_share)]
                cols = list(zip(*found, strict=True)) if found else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "share", "first_word", "n_words", "seed_hits"])

        part = materialize(docs.mapInArrow(run, "doc_id long, item_id long, share double, first_word long, n_words long, seed_hits long"), "contaminated")
        shared.destroy()
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, share double, first_word long, n_words long, seed_hits long")
    return out
