import random
import zlib

import numpy as np
import pyarrow as pa

from vellum.llm import toxicity, wordhash
from vellum.llm.toxicity import fit, toxicity_scores

STEMS = ["ba", "ko", "li", "mu", "ne", "po", "ra", "si", "tu", "ve"]


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(STEMS) for _ in range(rng.randrange(2, 5)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zigots", "grumph"]) if i % 2 else "wexto" + rng.choice(STEMS))
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus(1500, 1)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity_scores(docs, marks).collect()}
    assert len(out) == len(rows)
    held = [i for i in out if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out == (i in set(held)) for i in out)
    assert np.mean([out[i].predicted == labels[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())


def test_held_out_labels_and_other_columns_are_no_inputs(spark):
    texts, labels = corpus(300, 2)
    docs = lambda lang: spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    flip = [1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y for i, y in enumerate(labels)]
    run = lambda d, y: sorted(tuple(r) for r in toxicity_scores(d, spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")).collect())
    assert run(docs("en"), labels) == run(docs("fr"), flip)


def test_edges(spark):
    texts, labels = corpus(200, 3)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (900, None), (901, ""), (902, texts[0]), (902, texts[0]), (903, " ".join(texts) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*enumerate(labels), (None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, toxic int")
    out = toxicity_scores(docs, marks, ("doc_id", "text")).collect()
    assert len(out) == len(rows) and all(r.score is not None for r in out)
    assert len({r.score for r in out if r.doc_id == 902}) == 1
    nothing = toxicity_scores(docs, marks.limit(0)).collect()
    assert {(r.score, r.predicted) for r in nothing} == {(0.0, 0)}
    assert toxicity_scores(docs.limit(0), marks).count() == 0


def test_scores_by_brute_force():
    """Responses at every position, one by one."""
    texts, labels = corpus(120, 4)
    m = fit(texts, labels)
    for c in wordhash.chunks(pa.array(texts[:10] + ["", "one", "one two"])):
        rows = toxicity.word_rows(c)
        got = m.logits(c)
        for i in range(c.rows):
            x = m.table[rows[c.word_at[i] : c.word_at[i + 1]]].sum(axis=1)
            feats = []
            for w in toxicity.WIDTHS:
                best = np.zeros(toxicity.FILTERS)
                for p in range(len(x) - w + 1):
                    best = np.maximum(best, sum(x[p + j] @ m.filters[w][j] for j in range(w)) + m.bias[w])
                feats.append(best)
            assert abs(np.concatenate(feats) @ m.out + m.out_bias - got[i]) < 1e-3


def test_long_text_in_parts(monkeypatch):
    """Scores don't depend on how many words are scored at once."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["bad", "good", "so", "so", "x%d" % rng.randrange(99)]) for _ in range(n)) for n in (3, 700, 1, 2500, 90)]
    model = fit([f"bad {i} words" for i in range(30)] + [f"good {i} words" for i in range(30)], [1] * 30 + [0] * 30)
    chunk = next(wordhash.chunks(pa.array(texts)))
    whole = model.logits(chunk)
    monkeypatch.setattr("vellum.llm.toxicity.PART", 64)
    assert np.allclose(model.logits(chunk), whole, atol=1e-5)
