"""Best-fit packing of token sequences into rows of a fixed length.

Documents longer than a row are cut; full pieces are rows of their own.  All
other pieces are packed by best-fit decreasing.  Best fit looks at lengths
alone, so the plan is made from the histogram of lengths, which has at most
``capacity`` entries for any corpus: bins that have the same room left are one
entry of a segment tree over remaining capacities, which finds the tightest
open bin in logarithmic time.  The plan maps runs of pieces of one length (by
rank) to runs of bins; every piece then finds its place on its own executor.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed each; equal lengths are ranked by document and piece, so ties don't
change how many sequences there are; an empty table gives no rows; other
columns of the input play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress, count, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.workspace import bounded_batches, materialize

CAPACITY = 4096
END = 1
#: Ranks within a length are counted in so many parts, so no length is one task's.
PARTS = 64
#: Words whose ids a worker keeps, and their characters: the first that it meets, so nearly all frequent ones.
CACHE_WORDS, CACHE_CHARS = 500_000, 8_000_000


#: A word of lower-case Latin-1 letters, then ASCII points: the vocabulary parts them there, and normalization leaves both as they are.
_STEM = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z").match


def _latin(text: str) -> bool:
    """Whether a text has only characters to U+00FF, which have one lower-case form whatever stands beside them."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _split(text: str) -> list[str]:
    """Blank-separated words; those of Latin-1 texts, and ASCII ones, in lower case, as the vocabulary has them."""
    if "<|" in text:  # special tokens are told by their case
        return text.replace("\n", " ").split(" ")
    if _latin(text):
        return text.lower().replace("\n", " ").split(" ")
    return [w.lower() if w.isascii() else w for w in text.replace("\n", " ").split(" ")]


class CachedTokenizer:
    """Ids of texts as the tokenizer gives them, by way of their blank-separated words.

    The vocabulary drops white space and never joins across it, so a text's ids
    are those of its words in turn.  Known words have their ids as bytes, little-endian.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for words that normalization leaves as they are and that are one unit each
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def _encode_units(self, tokenizer, words: list[str]) -> dict[str, bytes]:
        """Ids of letters-only words, many to a text: each is one unit, whose last id alone ends a word."""
        found: dict[str, bytes] = {}
        parts = [words[i : i + 400] for i in range(0, len(words), 400)]
        for part, e in zip(parts, tokenizer.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.closing[ids]) + 1)
            if len(ends) == len(part):  # every word has one end at least, so each has just one
                raw, ends = ids.tobytes(), ends.tolist()
                found.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends)), strict=True))
        return found

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct unknown words, in the tokenizer's hands only once for each stem."""
        found: dict[str, bytes] = {}
        parted, units, rest = [], {}, []
        for w in words:
            m = _STEM(w)
            if not m:
                rest.append(w)
                continue
            stem, points = m.groups()
            if points:
                parted.append((w, stem, points))
            if stem in self.known:
                found[stem] = self.known[stem]
            else:
                units[stem] = None
        found |= self._encode_units(self.plain, list(units))
        points = dict.fromkeys(p for _, _, p in parted)
        found |= self._encode_units(self.tokenizer, [w for w in rest if w.isalpha()])
        rest = [w for w in chain(units, points, rest) if w not in found]
        found.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        for w, stem, p in parted:
            found[w] = found[stem] + found[p]
        return found

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        ids, lost = [], []  # lost: places of unknown words, and those words
        for text in texts:
            words = _split(text)
            own = list(map(self.known.get, words))
            at = list(compress(count(), map(is_, own, repeat(None))))
            lost.append((at, [words[i] for i in at]))
            ids.append(own if at else [b"".join(own)])
        missing = list(dict.fromkeys(chain.from_iterable(words for _, words in lost)))
        found = self._encode_words(missing) if missing else {}
        for own, (at, words) in zip(ids, lost, strict=True):
            for i, w in zip(at, words, strict=True):
                own[i] = found[w]
        size = sum(map(len, missing))
        if len(self.known) < CACHE_WORDS and self.chars + size <= CACHE_CHARS:  # what comes later is rare: it isn't kept
            self.known.update((w, found[w]) for w in missing)
            self.chars += size
        return list(map(b"".join, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.encode_bytes(texts)]


@lru_cache(maxsize=1)
def encoder(path: str) -> CachedTokenizer:
    """A worker's tokenizer, with the words it knows from earlier tasks."""
    return CachedTokenizer(path)


_END = np.uint32(END).astype("<u4").tobytes()


def _cut(doc: int | None, tokens: bytes, capacity: int) -> list[tuple]:
    """The pieces of a document that fills more than one sequence."""
    raw = tokens + _END
    pieces = [raw[start : start + 4 * capacity] for start in range(0, len(raw), 4 * capacity)]
    return [(doc, i, i * capacity, len(p) // 4, zlib.crc32(p)) for i, p in enumerate(pieces)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """documents(doc_id, text) -> doc_id, piece, start, length, ids_crc32: each document's ids and the end token, cut at capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list = []
                for doc, tokens in zip(part.column(0).to_pylist(), own_encoder.encode_bytes(part.column(1).fill_null("").to_pylist()), strict=True):
                    if len(tokens) < 4 * capacity:
                        rows.append((doc, 0, 0, len(tokens) // 4 + 1, zlib.crc32(_END, zlib.crc32(tokens))))
                    else:
                        rows += _cut(doc, tokens, capacity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class RoomTree:
    """A segment tree over remaining capacities 0..capacity that holds whether a bin with that room is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, length: int) -> int:
        """The smallest room of at least length that an open bin has, or -1."""
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


@dataclass
class Plan:
    """Runs of ranks of one length that go to consecutive bins at one offset."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over lengths with their counts, whole runs of equal pieces and equal bins at a time."""
    tree = RoomTree(capacity)
    open_bins: dict[int, list[list[int]]] = {}  # room -> runs [first bin, count]
    bins, out = 0, []

    def put(room: int, first: int, count: int) -> None:
        if not room:
            return
        runs = open_bins.setdefault(room, [])
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1][1] += count
        else:
            runs.append([first, count])
        tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length
                many = left // each
                if many:  # so many new bins, each filled with this length alone
                    for k in range(each):
                        out.append((length, rank, bins, k * length))
                        rank += many
                    left -= each * many
                    put(capacity - each * length, bins, many)
                    bins += many
                else:
                    out.append((length, rank, bins, 0))
                    rank, left = rank + 1, left - 1
                    put(capacity - length, bins, 1)
                    bins += 1
                continue
            runs = open_bins[room]
            run = runs[-1]
            taken = min(left, run[1])
            run[1] -= taken
            first = run[0] + run[1]
            if not run[1]:
                runs.pop()
                if not runs:
                    tree.set(room, False)
            out.append((length, rank, first, capacity - room))
            rank, left = rank + taken, left - taken
            put(room - length, first, taken)
    cols = [np.array(x, np.int64) for x in zip(*sorted(out), strict=True)] if out else [np.empty(0, np.int64)] * 4
    return Plan(*cols, bins)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, length, ...) -> the same with sequence_id and offset.

    pieces is read more than once: pass a materialized table.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)))
    counts = materialize(rows.groupBy("length", "part").count(), "lengths")
    found = counts.groupBy("length").agg(F.sum("count").alias("n")).collect()  # at most capacity rows
    plan = best_fit_decreasing({r.length: r.n for r in found}, capacity)
    if not plan.bins:
        return pieces.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    before = counts.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))).join(F.broadcast(before), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before") - 1).select(*columns, "rank")
    shared = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        starts = p.length * (1 << 44) + p.rank
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(p.bin[i] + rank - p.rank[i]), pa.array(p.offset[i])],
                names=[*columns, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """documents(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
