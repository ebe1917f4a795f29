"""Toxicity scores from a small convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed table rows: two for the word and one
each for its first 4, 5 and 6 bytes, so inflected forms share something and a
collision in one table alone doesn't count for much.  Filters of several
widths run over the words; each filter's largest response in the text is a
feature of a logistic output.  Thresholds are calibrated by language, which is
guessed from the text's own function words; the score is shifted so that each
language's threshold stands at ``DECISION``.

Labels, language, source and id columns are never inputs of a score.  The
model is fitted on at most ``TRAIN_ROWS`` labelled rows (half of each class,
chosen by a hash of the id) with texts of at most ``TRAIN_BYTES`` bytes; every
text is scored whole, a very long one in parts of bounded size.

Defined cases: null and blank texts are scored as texts without words; without
labels of both classes every score is 0; a document labelled twice counts as
toxic if any label says so; rows with a null label or id teach nothing; a null
doc_id isn't held out; repeated rows each give a row; an empty table gives none; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import wordhash
from vellum.llm.workspace import bounded_batches

TRAIN_ROWS = 6000
#: Labelled texts of more bytes aren't learnt from, so that what the driver gathers is bounded.
TRAIN_BYTES = 1 << 16
DECISION = 0.7
_ROWS, _DIM = 1 << 16, 8
_PREFIXES = (4, 5, 6)
_TABLES = 2 + len(_PREFIXES)
WIDTHS, FILTERS = (1, 2, 3), 8
#: Words whose responses are held at once.
PART = 16384
EPOCHS, BATCH, RATE = 8, 48, 0.08
_U = np.uint64
#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with was on as be at by this are from or an",
    "de": "der die und das ist ein eine auf für sich nicht den mit dem im von zu auch",
    "fr": "le les des et dans est un une du que pour en au qui sur pas par",
    "es": "el los las del que y por con una se para como es su al lo",
}


def word_rows(c: wordhash.Chunk) -> np.ndarray:
    """For each word the table rows that make up its embedding."""
    out = np.empty((len(c.words), _TABLES), np.int32)
    low = _U(_ROWS - 1)
    out[:, 0] = c.words & low
    out[:, 1] = ((c.words >> _U(32)) & low).astype(np.int32) + _ROWS
    for t, n in enumerate(_PREFIXES, 2):
        h = wordhash.hash_words(c.data, c.starts, np.minimum(c.starts + n, c.ends))
        out[:, t] = ((h >> _U(20)) & low).astype(np.int32) + t * _ROWS
    return out


def _language_words() -> tuple[np.ndarray, np.ndarray]:
    hashes, lang = [], []
    for i, words in enumerate(FUNCTION_WORDS.values()):
        c = next(wordhash.chunks(pa.array([words])))
        hashes.append(c.words)
        lang.append(np.full(len(c.words), i))
    h, g = np.concatenate(hashes), np.concatenate(lang)
    order = np.argsort(h)
    return h[order], g[order]


def languages(c: wordhash.Chunk, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The language of each row by its function words; one past the last for none."""
    n = len(FUNCTION_WORDS)
    counts = np.zeros((c.rows, n), np.int64)
    row = np.repeat(np.arange(c.rows), np.diff(c.word_at))
    at = np.searchsorted(known[0], c.words)
    at[at == len(known[0])] = 0
    for shift in (0, 1):  # a word may stand in two lists
        i = np.minimum(at + shift, len(known[0]) - 1)
        hit = known[0][i] == c.words
        np.add.at(counts, (row[hit], known[1][i[hit]]), 1)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), n)


def embed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = table[rows[:, 0]]
    for t in range(1, _TABLES):
        x += table[rows[:, t]]
    return x


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, dim, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    fitted: bool = True

    def responses(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Filter responses at each word, one width after the other; windows that leave their text get a very small one."""
        n = len(x)
        joined = np.concatenate([self.filters[w][j] for w in WIDTHS for j in range(w)], axis=1)
        parts = x @ joined
        out = np.full((n, len(WIDTHS) * FILTERS), -1e9, np.float32)
        first = 0
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for i, w in enumerate(WIDTHS):
            if n >= w:
                own = out[: n - w + 1, i * FILTERS : (i + 1) * FILTERS]
                own[:] = self.bias[w]
                for j in range(w):
                    own += parts[j : n - w + 1 + j, (first + j) * FILTERS : (first + j + 1) * FILTERS]
                if w > 1:
                    own[row[: n - w + 1] != row[w - 1 :]] = -1e9
            first += w
        return out

    def pooled(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at) - 1, len(WIDTHS) * FILTERS), np.float32)
        has = np.flatnonzero(np.diff(at))
        if len(has):
            out[has] = np.maximum(np.maximum.reduceat(self.responses(embed(self.table, rows), at), at[has]), 0)
        return out

    def logits(self, c: wordhash.Chunk) -> np.ndarray:
        out = np.empty((c.rows, len(WIDTHS) * FILTERS), np.float32)
        rows, row = word_rows(c), 0
        while row < c.rows:  # some rows at a time: responses take many bytes a word
            last = max(row + 1, int(np.searchsorted(c.word_at, c.word_at[row] + PART, side="right")) - 1)
            lo, hi = c.word_at[row], c.word_at[last]
            if hi - lo > PART:  # one long text: its parts overlap by a window less a word
                parts = (rows[p : min(hi, p + PART + max(WIDTHS) - 1)] for p in range(lo, hi, PART))
                out[row] = np.max([self.pooled(x, np.array([0, len(x)]))[0] for x in parts], axis=0)
            else:
                out[row:last] = self.pooled(rows[lo:hi], c.word_at[row : last + 1] - lo)
            row = last
        return out @ self.out + self.out_bias

    def scores(self, c: wordhash.Chunk, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(c.rows)
        z = self.logits(c) - self.threshold[languages(c, known)] + np.log(DECISION / (1 - DECISION))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _new_model(rng: np.random.Generator) -> Model:
    return Model(
        table=rng.normal(0, 0.05, (_TABLES * _ROWS, _DIM)).astype(np.float32),
        filters={w: rng.normal(0, 0.4, (w, _DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
        bias={w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        out=np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32),
    )


def _train_step(m: Model, rows: np.ndarray, at: np.ndarray, y: np.ndarray, state: dict[str, np.ndarray]) -> None:
    """One step of Adagrad on a batch; only table rows behind the largest responses move."""
    x = embed(m.table, rows)
    docs = np.flatnonzero(np.diff(at))
    width = len(WIDTHS) * FILTERS
    feats = np.zeros((len(at) - 1, width), np.float32)
    pos = np.empty((0, width), np.int64)
    if len(docs):
        r = m.responses(x, at)
        pos = np.stack([at[d] + np.argmax(r[at[d] : at[d + 1]], axis=0) for d in docs])
        feats[docs] = np.maximum(r[pos, np.arange(width)], 0)
    z = feats @ m.out + m.out_bias
    g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)).astype(np.float32)
    steps = {"out": feats.T @ g, "out_bias": np.array([g.sum()], np.float32)}
    moved, grads = [], []
    for i, w in enumerate(WIDTHS):
        own = g[docs, None] * m.out[None, i * FILTERS : (i + 1) * FILTERS] * (feats[docs, i * FILTERS : (i + 1) * FILTERS] > 0)
        steps[f"b{w}"] = own.sum(axis=0)
        df = np.zeros_like(m.filters[w])
        live = np.nonzero(own)
        for j in range(w):
            words = np.minimum(pos[:, i * FILTERS : (i + 1) * FILTERS] + j, len(x) - 1)
            df[j] = np.einsum("df,dfk->kf", own, x[words])
            moved.append(words[live])
            grads.append(own[live][:, None] * m.filters[w][j].T[live[1]])
        steps[f"f{w}"] = df
    if moved:
        idx = rows[np.concatenate(moved)]
        grad = np.repeat(np.concatenate(grads), _TABLES, axis=0)
        uniq, inverse = np.unique(idx.reshape(-1), return_inverse=True)
        total = np.zeros((len(uniq), _DIM), np.float32)
        np.add.at(total, inverse, grad)
        state["table"][uniq] += (total**2).mean(axis=1)
        m.table[uniq] -= RATE * total / (np.sqrt(state["table"][uniq]) + 1e-6)[:, None]
    for name, step in steps.items():
        target = m.out if name == "out" else m.filters[int(name[1])] if name[0] == "f" else m.bias[int(name[1])] if name[0] == "b" else None
        state[name] = state.get(name, 0) + step**2
        move = RATE * step / (np.sqrt(state[name]) + 1e-6)
        if target is None:
            m.out_bias -= float(move[0])
        else:
            target -= move.astype(np.float32)


def fit(texts: list[str | None] | pa.ChunkedArray, labels: list[int], seed: int = 0) -> Model:
    """A model from labelled texts; every fifth is kept back for the thresholds."""
    rng = np.random.default_rng(seed)
    m = _new_model(rng)
    y = np.array(labels, np.float32)
    if not (y == 1).any() or not (y == 0).any():
        m.fitted = False
        return m
    rows, at, lang, known = [], [0], [], _language_words()
    for c in wordhash.chunks(texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string())):
        rows.append(word_rows(c))
        at += (c.word_at[1:] + at[-1]).tolist()
        lang.append(languages(c, known))
    rows, at, lang = np.concatenate(rows), np.array(at), np.concatenate(lang)
    kept = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~kept)
    state: dict[str, np.ndarray] = {"table": np.zeros(len(m.table), np.float32)}

    def gather(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = at[docs + 1] - at[docs]
        own = np.concatenate([[0], np.cumsum(size)])
        return rows[np.repeat(at[docs] - own[:-1], size) + np.arange(own[-1])], own

    for _ in range(EPOCHS if len(train) > 500 else 4 * EPOCHS):
        order = rng.permutation(train)
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            _train_step(m, *gather(batch), y[batch], state)
    m.table[state["table"] == 0] = 0  # rows that never mattered say nothing
    judge = np.flatnonzero(kept) if kept.any() else train
    z = np.concatenate([m.pooled(*gather(judge[i : i + 256])) @ m.out + m.out_bias for i in range(0, len(judge), 256)])
    m.threshold[:] = _cut(z, y[judge])
    for g in range(len(m.threshold)):
        own = lang[judge] == g
        if min((y[judge][own] == 1).sum(), (y[judge][own] == 0).sum()) >= 15:
            m.threshold[g] = _cut(z[own], y[judge][own])
    return m


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which balanced accuracy is best."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    below = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    above = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    good = below + above
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float((edges[best[0]] + edges[best[-1]]) / 2)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded, hash-chosen sample of labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 0").orderBy(order, "doc_id").limit(TRAIN_ROWS // 2).union(known.where("toxic = 1").orderBy(order, "doc_id").limit(TRAIN_ROWS // 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most TRAIN_ROWS ids
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    found = rows.withColumn("o", order).orderBy("o", "doc_id", "text").limit(TRAIN_ROWS).select("text", "toxic").toArrow()
    return fit(found.column("text"), found.column("toxic").to_pylist())


def toxicity_scores(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, toxic) -> columns of documents, held_out, score, predicted: one row per document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    own = (*columns, "held_out") if "text" in columns else (*columns, "held_out", "__text")
    source = columns.index("text") if "text" in columns else len(own) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _language_words()
        for batch in batches:
            parts = [shared.value.scores(c, known) for c in wordhash.chunks(batch.column(source))]
            score = np.concatenate(parts).astype(np.float64) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns) + 1], pa.array(score), pa.array((score >= DECISION).astype(np.int32))], names=[*columns, "held_out", "score", "predicted"])

    rows = docs.select(*(F.col(f"`{c}`") for c in columns), held_out(F.col("doc_id")).alias("held_out"), *([] if "text" in columns else [F.col("text").cast("string").alias("__text")]))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "held_out boolean, score double, predicted int"]))
