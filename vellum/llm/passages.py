"""Substring dedup: passages that stand in more than one place, found by MinHash banding of overlapping paragraphs.

Method: every ``INTACT`` words in a row are a paragraph, wherever line breaks
fall, because copies break lines differently and begin inside them.  A
paragraph's signature is the five-word shingle of the least hash in each band,
with the ``MORE`` words after it, which keep stock phrases apart; paragraphs that
overlap mostly have the same, so two places in twelve words carry all signatures.
``bands`` tunes the signature: a passage of
``MIN_WORDS`` words or more at a Jaccard similarity of 0.75 has ``INTACT`` equal
words in a row at least (``shortest_intact``), so a paragraph without an edit,
and one band of one row finds that for certain; more bands or rows would find
nothing else.

Places with equal signatures are joined to the first of them, neighbouring ones
on one diagonal make a run (the words between are compared by their hash), and
runs are extended to all equal words.  Runs of fewer than ``MIN_WORDS`` words
are extended over edits and verified by the exact Jaccard of their five-word
shingles.  Places that don't resemble the first one are joined once more, by
the ``INTACT`` words round them.  Passages that are joined make clusters by
connected components; in each the earliest occurrence stays.

Defined cases: null and blank texts, and texts of fewer than ``MIN_WORDS``
words, have no passages; the occurrence that stays is the first by doc_id
(rows without one, and rows whose doc_id stands over several texts, after all
others), then place; inside one document a repeat counts if it has
``MIN_WITHIN`` words and stands that far apart at least, so refrains and phrases
said over and over don't; rows alike in id and text are one
document; an empty table gives no rows; very long texts are read whole; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import wordhash
from vellum.llm.components import components
from vellum.llm.workspace import bounded_batches, discard, materialize, sized

MIN_WORDS, MIN_WITHIN = 20, 50
THRESHOLD, RECALL = 0.75, 0.98
#: Words after a shingle that belong to its signature.
MORE = 3
#: Words to either side of a run in which it is extended: equal ones, and over edits.
EXACT, ROUND = 24, 36
#: Equal words that take a passage up again after an edit, and words of both sides that one edit takes at most.
RESUME, EDIT = 5, 8
#: Words between repeated ones that don't end a passage.
GAP = 16
#: Row numbers from here on are hashes: rows that doc_id doesn't tell apart.
_HASHED = 1 << 62
#: Ids that are broadcast at most to choose documents by: one long each.
IDS = 1_000_000
_U = np.uint64
_STEPS = sorted(((i, j) for i in range(EDIT) for j in range(EDIT) if 0 < i + j <= EDIT), key=lambda x: (sum(x), abs(x[0] - x[1])))


def shortest_intact(min_words: int, threshold: float) -> int:
    """The fewest equal words in a row that a passage of min_words words at the threshold can have.

    Words changed near its ends cost a shingle for each word from the end; inside, the
    cheapest edit is a lost word, and e of them leave n - 5e - 4 common shingles of n + 4e - 4.
    """
    k, least = wordhash.SHINGLE, min_words
    for n in range(min_words, 40 * min_words):
        lost = int((1 - threshold) * (n - k + 1) / (1 + threshold) + 1e-9)
        least = min(least, n - min(lost, 2 * k))
        for e in range(1, n // k):
            if n - k * e - k + 1 >= threshold * (n + (k - 1) * (e - 1)):
                least = min(least, -(-(n - e) // (e + 1)))
    return least


#: Words in a row that every passage has: those of a paragraph; the words of a signature; the signatures to choose from in a paragraph.
INTACT = shortest_intact(MIN_WORDS, THRESHOLD)
_KEY = wordhash.SHINGLE + MORE
_SPAN = INTACT - _KEY + 1


def bands(threshold: float = THRESHOLD, recall: float = RECALL, chances: int = 1, background: float = 0.0, noise: float = 0.01) -> tuple[int, int]:
    """Bands and rows of a MinHash signature that find a paragraph at the threshold with the recall.

    chances: paragraphs tried for each passage.  Of all rows per band that keep
    paragraphs of the background similarity from colliding at more than the noise
    rate, those that need the fewest hashes.
    """
    fits = []
    for rows in range(1, 9):
        n = next((n for n in range(1, 65) if 1 - (1 - threshold**rows) ** (n * chances) >= recall), None)
        if n and 1 - (1 - background**rows) ** n <= noise:
            fits.append((n * rows, n, rows))
    return min(fits)[1:]


def _least(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places whose shingle hash is the least of a paragraph; of equal ones that follow each other, one in every few."""
    n = len(h) - _SPAN + 1
    if n < 1:
        return np.empty(0, np.int64)

    def slide(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
        width = 1
        while 2 * width <= _SPAN:
            x, width = pick(x[: len(x) - width], x[width:]), 2 * width
        rest = _SPAN - width
        return pick(x[: len(x) - rest], x[rest:]) if rest else x

    least = slide(h, np.minimum)
    least[row[:n] != row[_SPAN - 1 :]] = 0  # not inside one text
    edge = np.zeros(_SPAN - 1, h.dtype)
    at = np.flatnonzero((slide(np.concatenate([edge, least, edge]), np.maximum) == h) & (h > 0))
    if not len(at):
        return at
    tied = np.append(False, (h[at[1:]] == h[at[:-1]]) & (np.diff(at) < _SPAN) & (row[at[1:]] == row[at[:-1]]))
    first = at[np.maximum.accumulate(np.where(tied, 0, np.arange(len(at))))]
    step = (at - first) // 4
    return at[~tied | np.append(False, step[1:] != step[:-1])]


def seed_table(docs: DataFrame, n_bands: int) -> DataFrame:
    """docs(row, text) -> key, row, at: the paragraphs' signatures.

    at: the place (word) of the least shingle in the top half, then 8 bits for the words to
    the next place and 24 bits of those words' hash, 0 if there is none.
    """
    seeds = np.random.default_rng(11).integers(1, 2**63, n_bands, dtype=_U) * _U(2) + _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for c in wordhash.chunks(batch.column(1)):
                h, word, _ = wordhash.shingles(c)
                row = np.searchsorted(c.word_at, word, side="right") - 1
                whole = (word + _KEY <= c.word_at[row + 1]) & (np.diff(c.word_at)[row] >= MIN_WORDS)
                h, word, row = h[whole], word[whole], row[whole]
                for seed in seeds:
                    own = wordhash.mix(h * seed) | _U(1)
                    at = _least(own, row)
                    if len(at):
                        key = wordhash.mix(own[at] + sum(c.words[word[at] + wordhash.SHINGLE + i] * wordhash._STEP[100 + i] for i in range(MORE)))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rows[c.first + row[at]]), pa.array(_linked(c, word[at], row[at]))], names=["key", "row", "at"])

    return docs.select("row", "text").mapInArrow(run, "key long, row long, at long")


def _linked(c: wordhash.Chunk, word: np.ndarray, row: np.ndarray) -> np.ndarray:
    ends = np.append(word[1:], len(c.words))
    same = np.append(row[1:] == row[:-1], False)
    local = np.arange(word[0], ends[-1]) - np.repeat(word, ends - word)
    sums = np.add.reduceat(c.words[word[0] : ends[-1]] * wordhash._STEP[np.minimum(local, 127)], word - word[0])
    low = ((ends - word).astype(_U) << _U(24)) | (wordhash.mix(sums) >> _U(40))
    low[~(same & (ends - word < 128))] = 0
    return (((word - c.word_at[row]).astype(_U) << _U(32)) | low).view(np.int64)


def windows(docs: DataFrame) -> DataFrame:
    """docs(row, text, wanted array<struct<place, kind>>) -> row, place, kind, offset, words.

    words: the low 32 bits of the hashes of EXACT words before a place (kind l) or after it
    (r), or of all round it (w); offset: where the place is among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
        for batch in batches:
            rows, wanted = batch.column(0).to_pylist(), batch.column(2)
            for c in wordhash.chunks(batch.column(1)):
                low, out = c.words.astype(np.uint32), []
                for r in range(c.rows):
                    own = low[int(c.word_at[r]) : int(c.word_at[r + 1])]
                    for w in wanted[c.first + r]:
                        place, kind = w["place"].as_py(), w["kind"].as_py()
                        lo = place if kind == "r" else max(0, place - (EXACT if kind == "l" else ROUND))
                        hi = place if kind == "l" else place + (EXACT if kind == "r" else ROUND + MIN_WORDS)
                        out.append((rows[c.first + r], place, kind, place - lo, own[lo:hi].tobytes()))
                cols = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["row", "place", "kind", "offset", "words"])

    return docs.select("row", "text", "wanted").mapInArrow(run, "row long, place long, kind string, offset int, words binary")


def _grown(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """From the starts of a and b on: stretches (place in a, place in b, words) of equal words, taken up again after edits."""
    i = j = 0
    out = []
    while True:
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        if n:
            out.append((i, j, n))
        i, j = i + n, j + n
        for x, y in _STEPS:
            if i + x + RESUME <= len(a) and a[i + x : i + x + RESUME] == b[j + y : j + y + RESUME]:
                i, j = i + x, j + y
                break
        else:
            return out


def _alike(a: list[int], b: list[int]) -> bool:
    k = wordhash.SHINGLE
    x, y = ({tuple(z[i : i + k]) for i in range(len(z) - k + 1)} for z in (a, b))
    both = len(x & y)
    return both > 0 and both >= THRESHOLD * (len(x) + len(y) - both)


def extended(a: list[int], b: list[int], at_a: int, at_b: int, n: int, min_words: int) -> tuple[int, int, int, int] | None:
    """The passage round n equal words at at_a and at_b: its first and past-last word in a and in b.

    It has min_words words in both and five-word shingles of a Jaccard similarity of the
    threshold, else None; edits at its ends that take it below are cut off, the end
    with the shorter stretch of equal words first.
    """
    if a[at_a : at_a + n] != b[at_b : at_b + n]:
        return None
    right = [(at_a + i, at_b + j, k) for i, j, k in _grown(a[at_a:], b[at_b:])]
    left = [(at_a - i - k, at_b - j - k, k) for i, j, k in _grown(a[:at_a][::-1], b[:at_b][::-1])]
    if left and left[0][0] + left[0][2] == at_a and right and right[0][0] == at_a:
        x = left.pop(0)
        right[0] = (x[0], x[1], x[2] + right[0][2])
    runs = left[::-1] + right
    while runs:
        first, last = runs[0], runs[-1]
        span = first[0], last[0] + last[2], first[1], last[1] + last[2]
        if min(span[1] - span[0], span[3] - span[2]) < min_words:
            return None
        if _alike(a[span[0] : span[1]], b[span[2] : span[3]]):
            return span
        runs = runs[1:] if first[2] < last[2] else runs[:-1]
    return None


def changed_at_ends(a: list[int], b: list[int], at_a: int, at_b: int, min_words: int) -> tuple[int, int, int, int] | None:
    """The equal words round two places with as many changed words at their ends as make them min_words, if they are alike then."""
    before = next((i for i in range(min(at_a, at_b)) if a[at_a - 1 - i] != b[at_b - 1 - i]), min(at_a, at_b))
    after = min(len(a) - at_a, len(b) - at_b)
    after = next((i for i in range(after) if a[at_a + i] != b[at_b + i]), after)
    lacks = min_words - before - after
    for left in range(lacks, -1, -1):
        span = at_a - before - left, at_a + after + lacks - left, at_b - before - left, at_b + after + lacks - left
        if min(span[0], span[2]) >= 0 and span[1] <= len(a) and span[3] <= len(b) and _alike(a[span[0] : span[1]], b[span[2] : span[3]]):
            return span
    return None


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) with row, which tells apart what doc_id and text do and is the doc_id where that does; and row, doc_id of the others."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = docs.select("doc_id", F.xxhash64("text").alias("h")).where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    clash = sized(materialize(kinds.where("lo <> hi").select("doc_id", F.lit(True).alias("clash")), "clashes"))
    hashed = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(_HASHED - 1)).bitwiseOR(F.lit(_HASHED))
    docs = docs.join(clash, "doc_id", "left").select("doc_id", "text", F.when(F.col("doc_id").isNull() | F.col("clash"), hashed).otherwise(F.col("doc_id")).alias("row"))
    return docs, materialize(docs.where(F.col("row") >= _HASHED).select("row", "doc_id").distinct(), "names")


def _first_of(keyed: DataFrame, *place: str) -> DataFrame:
    """key, first (struct): the first place of each key that has several; counted before the shuffle."""
    return keyed.groupBy("key").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")


def _windows_of(docs: DataFrame, ends: DataFrame, name: str) -> DataFrame:
    """windows for the distinct (row, place, kind) of ends: at most three for each word of a document."""
    wanted = materialize(ends.select("row", F.struct("place", "kind").alias("w")).groupBy("row").agg(F.collect_set("w").alias("wanted")), name)
    held = docs.join(sized(wanted.select("row"), IDS), "row", "left_semi")
    return materialize(windows(held.join(wanted, "row")), f"{name}_words")


def _intact(at_a: pa.Array, at_b: pa.Array, words_a: pa.Array, words_b: pa.Array) -> list[bool]:
    """Whether INTACT words round two places are equal, as every passage has them."""
    reach = np.arange(-INTACT, INTACT + 1)
    sides = []
    for at, words in ((at_a, words_a), (at_b, words_b)):
        size = np.array([len(x.as_buffer()) // 4 for x in words], np.int64)
        flat = np.concatenate([*(np.frombuffer(x.as_buffer(), np.uint32) for x in words), np.zeros(1, np.uint32)])
        place = at.to_numpy()[:, None] + reach
        inside = (place >= 0) & (place < size[:, None])
        sides.append((flat[np.where(inside, (np.cumsum(size) - size)[:, None] + place, 0)], inside))
    same = (sides[0][0] == sides[1][0]) & sides[0][1] & sides[1][1]
    edge = np.zeros((len(same), 1), bool)
    left = np.hstack([same[:, :INTACT][:, ::-1], edge]).argmin(axis=1)
    right = np.hstack([same[:, INTACT:], edge]).argmin(axis=1)
    return (left + right >= INTACT).tolist()


def _compared(tried: DataFrame, around: DataFrame, min_words: int) -> DataFrame:
    """tried(row, place, other, other_place, kind) -> row, first, past, other, other_first, whole (a passage by itself), place, other_place: what is equal, or for kind w a verified passage; first is null where there is none."""
    one, two = (around.select(F.col("row").alias(r), F.col("place").alias(p), "kind", F.col("offset").alias(f"at_{x}"), F.col("words").alias(f"words_{x}")) for r, p, x in (("row", "place", "a"), ("other", "other_place", "b")))
    both = tried.join(one, ["row", "place", "kind"]).join(two, ["other", "other_place", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        for batch in batches:
            out = []
            worth = _intact(batch.column(5), batch.column(6), batch.column(7), batch.column(8))
            for worthy, row, p, other, q, kind, at_a, at_b, x, y in zip(worth, *(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "w" and not worthy:
                    out.append((row, None, None, other, None, None, True, p, q))
                    continue
                a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if kind == "w":
                    a, b = a.tolist(), b.tolist()
                    s = extended(a, b, at_a, at_b, _KEY, min_words) or changed_at_ends(a, b, at_a, at_b, min_words)
                    whole = (p - at_a + s[0], p - at_a + s[1], q - at_b + s[2], q - at_b + s[3]) if s else (None,) * 4
                    out.append((row, *whole[:2], other, *whole[2:], True, p, q))
                    continue
                n = min(len(a), len(b))
                a, b = (a[len(a) - n :][::-1], b[len(b) - n :][::-1]) if kind == "l" else (a[:n], b[:n])
                n = int(np.append(a == b, False).argmin())
                if n:
                    out.append((row, p - n, p, other, q - n, q, False, p, q) if kind == "l" else (row, p, p + n, other, q, q + n, False, p, q))
            cols = zip(*out, strict=True) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=["row", "first", "past", "other", "other_first", "other_past", "whole", "place", "other_place"])

    columns = ("row", "place", "other", "other_place", "kind", "at_a", "at_b", "words_a", "words_b")
    return both.select(*columns).mapInArrow(run, "row long, first long, past long, other long, other_first long, other_past long, whole boolean, place long, other_place long")


def _contexts(around: DataFrame) -> DataFrame:
    """key, row, place: hashes of all INTACT words in a row that hold the signature at the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = wordhash._STEP[:INTACT]
        for batch in batches:
            keys, rows, places = [], [], []
            for row, place, offset, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(raw, np.uint32).astype(_U)
                lo, hi = max(0, offset + _KEY - INTACT), min(len(words), offset + INTACT)
                if hi - lo >= INTACT:
                    views = np.lib.stride_tricks.sliding_window_view(words[lo:hi], INTACT)
                    keys.append(wordhash.mix((wordhash.mix(views) * step).sum(axis=1, dtype=_U)).view(np.int64))
                    rows += [row] * len(views)
                    places += [place] * len(views)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)), pa.array(rows, pa.int64()), pa.array(places, pa.int64())], names=["key", "row", "place"])

    return around.select("row", "place", "offset", "words").mapInArrow(run, "key long, row long, place long")


def matches(docs: DataFrame, min_words: int = MIN_WORDS, min_within: int = MIN_WITHIN) -> tuple[DataFrame, DataFrame]:
    """docs(row, text) -> two tables (row, first, past, other, other_first, other_past): passages that stand at an earlier place too, and equal words at their ends."""
    seeds = materialize(seed_table(docs, bands(threshold=1.0)[0]), "seeds")
    place, low = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(2**32 - 1))
    firsts = materialize(_first_of(seeds, "row", "at"), "firsts")
    found = seeds.join(sized(firsts), "key").where((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    other_place, other_low = F.shiftright(F.col("first.at"), 32), F.col("first.at").bitwiseAND(F.lit(2**32 - 1))
    hits = found.select("key", "row", place.alias("place"), low.alias("low"), F.col("first.row").alias("other"), (place - other_place).alias("shift"), (low == other_low).alias("linked"))
    inside = hits.where("row = other").withColumn("nearest", F.min("shift").over(Window.partitionBy("row", "key"))).where(F.col("nearest") >= min_within)
    hits = hits.where("row <> other").union(inside.drop("nearest")).drop("key")
    w = Window.partitionBy("row", "other", "shift").orderBy("place")
    past = F.when(F.lag("linked").over(w) & (F.lag("low").over(w) > 0), F.lag("place").over(w) + F.shiftright(F.lag("low").over(w), 24))
    hits = hits.withColumn("fresh", F.when(past == F.col("place"), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    runs = hits.groupBy("row", "other", "shift", "run").agg(F.min("place").alias("first"), (F.max("place") + _KEY).alias("past")).drop("run")
    runs = materialize(runs.withColumn("strong", F.col("past") - F.col("first") >= min_words), "runs")
    discard(seeds)

    strong = runs.where("strong").select("row", "first", "past", "other", (F.col("first") - F.col("shift")).alias("other_first"), (F.col("past") - F.col("shift")).alias("other_past"))
    end = lambda c, kind: F.struct(F.col(c).alias("place"), F.lit(kind).alias("kind"))
    tried = runs.select("row", "other", "shift", F.explode(F.when(F.col("strong"), F.array(end("first", "l"), end("past", "r"))).otherwise(F.array(end("first", "w")))).alias("x"))
    tried = materialize(tried.select("row", "x.place", "other", (F.col("x.place") - F.col("shift")).alias("other_place"), "x.kind"), "tried")
    ends = tried.select("row", "place", "kind").union(tried.select("other", "other_place", "kind"))
    around = _windows_of(docs, ends, "around")
    compared = materialize(_compared(tried, around, min_words), "compared")

    # places whose signature's first place is no match: joined by the words round them
    failed = compared.where("whole and first is null")
    lone = failed.select("row", "place").union(failed.select("other", "other_place")).distinct()
    keyed = materialize(_contexts(around.where("kind = 'w'").join(lone, ["row", "place"], "left_semi")), "contexts")
    again = keyed.join(sized(materialize(_first_of(keyed, "row", "place"), "context_firsts")), "key").select("row", "place", F.col("first.row").alias("other"), F.col("first.place").alias("other_place"), F.lit("w").alias("kind"))
    again = materialize(again.where("row <> other or place <> other_place").distinct(), "again")
    more = materialize(_compared(again, around, min_words), "more")

    columns = ("row", "first", "past", "other", "other_first", "other_past")
    whole = compared.where("whole").union(more).where("first is not null").select(*columns)
    return strong.union(whole), compared.where("not whole").select(*columns)


def _inside(passages: DataFrame, ends: DataFrame, min_within: int) -> tuple[DataFrame, DataFrame]:
    """Of passages that stand twice in one document, and of the equal words at their ends, those with min_within words that don't overlap."""
    shift = F.col("first") - F.col("other_first")
    passages = passages.withColumn("shift", shift).where(F.col("shift") >= min_within)  # as second joins may not be
    ends = materialize(ends.withColumn("shift", shift), "ends")
    before = ends.select("row", "shift", F.col("past").alias("first"), (F.col("past") - F.col("first")).alias("before"))
    after = ends.select("row", "shift", F.col("first").alias("past"), (F.col("past") - F.col("first")).alias("after"))
    sized_up = passages.join(before, ["row", "shift", "first"], "left").join(after, ["row", "shift", "past"], "left")
    words = F.col("past") - F.col("first") + F.coalesce("before", F.lit(0)) + F.coalesce("after", F.lit(0))
    kept = materialize(sized_up.where(words >= min_within).select(*passages.columns).distinct(), "inside")
    bounds = kept.select("row", "shift", F.explode(F.array("first", "past")).alias("bound")).distinct()
    ends = ends.withColumn("bound", F.explode(F.array("first", "past"))).join(bounds, ["row", "shift", "bound"], "left_semi")
    columns = ["row", "first", "past", "other", "other_first", "other_past"]
    return kept.select(columns), ends.select(columns).distinct()


def _merged(parts: DataFrame) -> DataFrame:
    """parts(row, first, past, gone) -> with start (of the passage), own and own_gone (words that no earlier part has).

    At most two rows for each word of a document, whatever the number of its copies.
    """
    parts = parts.groupBy("row", "first", "gone").agg(F.max("past").alias("past"))
    w = Window.partitionBy("row").orderBy("first", "past", "gone")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    never = F.lit(-(10**6)).cast("long")
    parts = parts.withColumn("reach", F.coalesce(F.max("past").over(before), never)).withColumn("reach_gone", F.coalesce(F.max(F.when(F.col("gone"), F.col("past"))).over(before), never))
    parts = parts.withColumn("start", F.max(F.when(F.col("first") - F.col("reach") > GAP, F.col("first"))).over(w))
    fresh = lambda reach: F.greatest(F.lit(0).cast("long"), F.col("past") - F.greatest("first", reach))
    return parts.withColumn("own", fresh("reach")).withColumn("own_gone", F.when(F.col("gone"), fresh("reach_gone")).otherwise(0))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_within: int = MIN_WITHIN) -> DataFrame:
    """documents(doc_id, text) -> doc_id, first_word, n_words, repeated_words, removed_words, cluster_id.

    One row for each passage with at least min_words words that stand elsewhere too;
    words are counted over the whole text.  removed_words: those of which an
    earlier occurrence stays.  cluster_id: the smallest doc_id of the documents with
    passages that hang together with this one.
    """
    bounded_batches(docs.sparkSession)
    docs, names = _rows(docs)
    docs = docs.dropDuplicates(["row"]) if _repeats(docs) else docs
    passages, ends = matches(docs, min_words, min_within)
    across = F.col("row") != F.col("other")
    inside, inside_ends = _inside(passages.where(~across), ends.where(~across), min_within)
    passages = materialize(passages.where(across).union(inside).distinct(), "passages")
    every = passages.union(ends.where(across)).union(inside_ends)
    parts = every.select("row", "first", "past", F.lit(True).alias("gone"))
    parts = parts.union(every.select("other", "other_first", "other_past", F.lit(False)))
    merged = materialize(_merged(parts), "merged")

    name = F.xxhash64("row", "start")
    found = merged.groupBy("row", "start").agg(F.max("past").alias("past"), F.sum("own").alias("repeated_words"), F.sum("own_gone").alias("removed_words"))
    found = materialize(found.where(F.col("repeated_words") >= min_words).withColumn("id", name), "found")
    spots = merged.select("row", "first", "gone", name.alias("id"))
    a = spots.where("gone").select("row", "first", F.col("id").alias("a"))
    b = spots.where("not gone").select(F.col("row").alias("other"), F.col("first").alias("other_first"), F.col("id").alias("b"))
    edges = passages.select("row", "first", "other", "other_first").join(a, ["row", "first"]).join(b, ["other", "other_first"]).select("a", "b").distinct()
    labels = components(edges)
    out = found.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = out.groupBy("label").agg(F.min("row").alias("cluster"))
    out = out.join(sized(materialize(least, "least")), "label")
    for column, to in (("row", "doc_id"), ("cluster", "cluster_id")):
        known = names.select(F.col("row").alias(column), F.col("doc_id").alias("real"))
        out = out.join(sized(known), column, "left").withColumn(to, F.when(F.col(column) < _HASHED, F.col(column)).otherwise(F.col("real"))).drop("real")
    return out.select("doc_id", F.col("start").alias("first_word"), (F.col("past") - F.col("start")).alias("n_words"), "repeated_words", "removed_words", "cluster_id")


def _repeats(docs: DataFrame) -> bool:
    """Whether rows repeat."""
    return not docs.groupBy("row").count().where("count > 1").isEmpty()
