import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from vellum.llm.packing import CachedTokenizer, RoomTree, best_fit_decreasing, pack_documents
from vellum.llm.queries import word_tokenizer


def plain_bins(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_tree():
    t, opened, rng = RoomTree(100), set(), random.Random(1)
    for _ in range(3000):
        r = rng.randrange(101)
        if rng.random() < 0.5:
            opened.add(r)
        else:
            opened.discard(r)
        t.set(r, r in opened)
        n = rng.randrange(1, 101)
        assert t.tightest(n) == min((x for x in opened if x >= n), default=-1)


def test_as_many_bins_as_plain_best_fit():
    rng = random.Random(2)
    for capacity in (10, 64, 100):
        for _ in range(30):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 200))]
            histogram = {n: lengths.count(n) for n in set(lengths)}
            plan = best_fit_decreasing(histogram, capacity)
            assert plan.bins == plain_bins(lengths, capacity)


def test_tokens_as_the_tokenizer_gives_them():
    odd = ["", " ", "It's  THE end.\n\n'll\t\x0bx y z", "<|endoftext|> a<|startoftext|>b", "é ́x ΣΙΣ 123 4éÉ!?\r\n\x85q", "''s's", "한文 \U0001f600‍ x"]
    plain = Tokenizer.from_file(word_tokenizer())
    assert [x.tolist() for x in CachedTokenizer(word_tokenizer()).encode(odd)] == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_tokens_of_random_words():
    """Letters of one and of two bytes, points, case and marks in any order: the tokenizer's ids, met first or known."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abzAZ\xdf\xe9\xc9\xff\xd7\xf7\xaa\xb5\u0301\u03a3\u0130", k=rng.randrange(1, 9))) + "".join(rng.choices(".,!?#%'&<|>_^=", k=rng.randrange(4))) for _ in range(3000)]
    texts = [" ".join(texts[i : i + 3]) for i in range(0, 3000, 3)] + ["\xc9A\xd6 \xdcber,%%% \xa0\xe9\x85z\n\xc0."]
    plain, own = Tokenizer.from_file(word_tokenizer()), CachedTokenizer(word_tokenizer())
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == want


def test_new_words_without_normalization():
    """Words of Latin-1 letters and ASCII points are parted here: the normalizing tokenizer gets the points alone, each once."""
    own, met = CachedTokenizer(word_tokenizer()), []

    class Recorder:
        def encode_batch_fast(self, texts, to=own.tokenizer, **kw):
            met.extend(texts)
            return to.encode_batch_fast(texts, **kw)

    text = "qwzx### qwzx,%%% Qwzx \xc9qwzx. \xe9qwzx### \xe9qwzx,%%%"
    plain = own.tokenizer
    own.tokenizer = Recorder()
    assert own.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sorted(met) == ["###", ",%%%", "."]


def check(spark, rows, capacity=4096):
    out = pack_documents(spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, length int"), word_tokenizer(), capacity).collect()
    plain = Tokenizer.from_file(word_tokenizer())
    want = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for p, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want.append((i, p, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plain_bins([w[3] for w in want], capacity)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_edges(spark):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x " * 9000), (4, "y " * 4095), (5, "y " * 4096)] + [(10 + i, "z " * rng.randrange(300)) for i in range(80)] + [(200, "same")] * 50
    check(spark, rows)
    check(spark, rows, 64)


def test_empty(spark):
    check(spark, [])
