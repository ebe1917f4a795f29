import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from vellum.llm import wordhash
from vellum.llm.decontaminate import GAP, MATCH, MISMATCH, _matches, contaminated, item_seeds, item_words, rarest, smith_waterman


def plain(item, window):
    best, rows = 0, [[0] * (len(window) + 1)]
    for a in item:
        row = [0]
        for j, b in enumerate(window, 1):
            row.append(max(0, rows[-1][j - 1] + (MATCH if a == b else MISMATCH), rows[-1][j] + GAP, row[-1] + GAP))
        best = max(best, *row)
        rows.append(row)
    return best


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in "ab")
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        score, start, end = smith_waterman(x, y)
        assert score == plain(a, b)
        assert score == 0 or plain(a, b[start:end]) == score


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def test_planted(spark):
    rng = random.Random(2)
    items = [words(rng, 40) for _ in range(6)] + [words(rng, 2), []]
    rows, want = [], set()
    for i in range(60):
        text = words(rng, 200)
        if i < 24:
            k = i % 6
            copy = list(items[k])
            for _ in range(i // 6 * 2):  # up to six edits
                p = rng.randrange(len(copy))
                copy[p : p + 1] = rng.choice([[], words(rng, 1), [copy[p], *words(rng, 1)]])
            text[100:100] = copy
            want.add((i, k))
        rows.append((i, " ".join(text).upper() if i % 2 else "\n".join(text)))
    rows += [(100, None), (101, ""), (102, " ".join(items[6])), (103, "x " * 50000 + " ".join(items[0])), (None, " ".join(items[1])), (104, " ".join(items[2]) * 1), (104, " ".join(items[2]))]
    want |= {(102, 6), (103, 0), (None, 1), (104, 2)}
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(w) if w else None) for k, w in enumerate(items)], "item_id long, text string")
    out = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want
    assert sum(r.doc_id == 104 for r in out) == 2
    for r in out:
        if r.doc_id is not None and r.doc_id < 6:
            assert r.share == 1 and (r.first_word, r.n_words) == (100, 40)


def test_against_all_windows(spark, sf_dir):
    """Every document aligned with every item, without seeds."""
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    bench = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    dw, bw = item_words([d["text"] for d in docs]), item_words([b["text"] for b in bench])
    want = set()
    for d, x in zip(docs, dw):
        for b, y in zip(bench, bw):
            parts = [x[p : p + 1500] for p in range(0, len(x), 1000)]  # no alignment that counts is 500 words long
            if np.isin(y, x).sum() >= 0.45 * len(y) and any(smith_waterman(y, z)[0] >= 0.45 * MATCH * len(y) for z in parts if np.isin(y, z).sum() >= 0.45 * len(y)):
                want.add((d["doc_id"], b["item_id"]))
    got = contaminated(spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string"), spark.createDataFrame([(b["item_id"], b["text"]) for b in bench], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_edited_copies(spark):
    """Copies of which every third or fourth word, or some at random, are changed: found wherever the unseeded alignment finds them."""
    rng = random.Random(3)
    items = [words(rng, n) for n in (15, 15, 16, 18, 20, 25, 38, 60) for _ in range(6)]
    common = words(rng, 12)
    rows, want = [], set()
    for k, item in enumerate(items):
        for way in range(8):
            copy = list(item)
            if way < 2:
                copy[2::3] = words(rng, len(copy[2::3]))
            elif way < 4:
                copy[3::4] = words(rng, len(copy[3::4]))
            else:
                for p in range(len(copy) - 1, -1, -1):
                    if rng.random() < (0.2, 0.3, 0.35, 0.4)[way - 4]:
                        copy[p : p + 1] = rng.choice([[], words(rng, 1), words(rng, 1), words(rng, 1), [copy[p], *words(rng, 1)]])
            text = [rng.choice(common) for _ in range(40)] + copy + words(rng, 60)
            if plain(item, text) >= 0.45 * MATCH * len(item):
                want.add((len(rows), k))
            rows.append((len(rows), " ".join(text)))
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert got <= want and len(want) > 250
    assert len(got) >= 0.98 * len(want)


def test_seeds_that_matter_stay():
    """Seeds that no document has aren't kept in place of those that one has; far too frequent ones go."""
    every = item_seeds([" ".join(f"w{i}" for i in range(40))])
    known = {int(h.view(np.int64)): 1 for h in every.hashes[:15]} | {int(every.hashes[15].view(np.int64)): 10**6}
    kept = rarest(every, known)
    assert {int(h.view(np.int64)) for h in kept.hashes} == set(list(known)[:15])
    assert len(rarest(every, {}).hashes) == 0


def test_hits_in_parts(monkeypatch):
    """Few hits at a time give the same alignments."""
    rng = random.Random(4)
    texts = [" ".join(words(rng, 5) + ["a b c d e f g h"] * 3 + words(rng, 30)) for _ in range(12)]
    seeds, items = item_seeds(texts), item_words(texts)
    chunk = next(wordhash.chunks(pa.array(texts)))
    whole = sorted(_matches(chunk, seeds, items, 0.45))
    monkeypatch.setattr("vellum.llm.decontaminate.MOST_HITS", 5000)
    assert sorted(_matches(chunk, seeds, items, 0.45)) == whole and len(whole) >= 12


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert contaminated(docs, bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0
