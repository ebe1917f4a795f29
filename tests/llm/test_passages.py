import random

import re

import pytest

from vellum.llm.passages import INTACT, MIN_WITHIN, MIN_WORDS, bands, extended, repeated_passages, shortest_intact


def words(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(n)]


def test_bands():
    for chances in (1, 3):
        n, rows = bands(0.75, 0.98, chances)
        assert 1 - (1 - 0.75**rows) ** (n * chances) >= 0.98
    n, rows = bands(0.75, 0.98, 1, background=0.3)
    assert rows > 1 and 1 - (1 - 0.75**rows) ** n >= 0.98


def run(spark, rows):
    return repeated_passages(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, words int, id int")).collect()


def test_planted_and_clean(spark):
    rng = random.Random(1)
    passages = [words(rng, 55 + 5 * k) for k in range(8)]
    rows = []
    for i in range(80):
        text = words(rng, 150)
        if i < 40:
            at = rng.randrange(150)
            text[at:at] = passages[i % 8]
        for at in range(20, len(text), rng.choice([25, 60, 1000])):
            text[at] += "\n"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, "short stock line of words\n" + " ".join(words(rng, 60))) for i in range(20)]
    out = run(spark, rows)
    assert {r.doc_id for r in out} == set(range(40))
    kept = {r.doc_id for r in out if r.removed_words == 0}
    assert kept == set(range(8))
    assert all(r.cluster_id == r.doc_id % 8 for r in out)


def test_edited_copies(spark):
    rng = random.Random(2)
    base = words(rng, 120)
    rows = [(0, " ".join(base))]
    for i in range(1, 12):
        text = list(base)
        for p in rng.sample(range(120), 5):
            text[p] = words(rng, 1)[0]
        rows.append((i, " ".join(text)))
    out = run(spark, rows)
    assert {r.doc_id for r in out} == set(range(12))


def test_edges(spark):
    rng = random.Random(3)
    text, long = " ".join(words(rng, 80)), " ".join(words(rng, 30000))
    text2, text3, text4 = (" ".join(words(rng, n)) for n in (90, 70, MIN_WITHIN))
    out = run(spark, [(1, None), (2, ""), (3, " \n\n "), (4, "a"), (4, "a"), (5, text), (6, text), (None, text), (7, long), (8, long), (9, f"{text}\n\n{text}"), (10, " ".join(["over and over the same six words again"] * 30)), (11, text2), (11, text2), (12, text3), (12, f"new words here {text3}"), (13, f"{text4} a b c {text4}")])
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.first_word, r.n_words, r.removed_words))
    by[12].sort()
    assert by == {5: [(0, 80, 0)], 6: [(0, 80, 80)], None: [(0, 80, 80)], 7: [(0, 30000, 0)], 8: [(0, 30000, 30000)], 9: [(0, 160, 160)], 12: [(0, 70, 0), (3, 70, 70)], 13: [(0, 103, 50)]}
    assert run(spark, []) == []


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def jaccard(a, b):
    x, y = ({tuple(z[i : i + 5]) for i in range(len(z) - 4)} for z in (a, b))
    return len(x & y) / max(1, len(x | y))


def test_against_brute_force(spark, sf_dir):
    """Both ways: words that MIN_WORDS in a row put in two documents are reported, and what is reported resembles another place."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    texts, where, covered = {i: split(t) for i, t in rows}, {}, {}
    for i, w in texts.items():
        for p in range(len(w) - MIN_WORDS + 1):
            where.setdefault(tuple(w[p : p + MIN_WORDS]), []).append((i, p))
    for spots in where.values():
        if len({i for i, _ in spots}) > 1:
            for i, p in spots:
                covered.setdefault(i, set()).update(range(p, p + MIN_WORDS))
    out, got = run(spark, rows), {}
    for r in out:
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    assert set(covered) <= set(got)
    missed = sum(len(c - got[i]) for i, c in covered.items())
    assert missed <= 0.01 * sum(map(len, covered.values()))
    for r in out:  # a passage: some MIN_WORDS words of it stand in another document, or MIN_WITHIN twice in this one, or it is an edited copy
        own = texts[r.doc_id][r.first_word : r.first_word + r.n_words]
        exact = any(len({s for s in where[tuple(own[p : p + MIN_WORDS])]}) > 1 for p in range(len(own) - MIN_WORDS + 1))
        if not exact:
            shared = {i for p in range(len(own) - 4) for i, w in texts.items() if i != r.doc_id and tuple(own[p : p + 5]) in {tuple(w[q : q + 5]) for q in range(len(w) - 4)}}
            assert any(jaccard(own, texts[i][q : q + n]) >= 0.75 for i in shared for q in range(len(texts[i])) for n in range(r.n_words - 2, r.n_words + 3))
        assert r.repeated_words >= MIN_WORDS and 0 <= r.removed_words <= r.repeated_words <= r.n_words


def test_shortest_intact():
    assert INTACT == 18 and shortest_intact(50, 0.75) <= 50
    rng = random.Random(10)
    for _ in range(3000):  # every passage at the threshold has that many equal words in a row
        one = list(range(rng.randrange(MIN_WORDS, 90)))
        two = list(one)
        for _ in range(rng.randrange(1, 4)):
            p = rng.randrange(len(two))
            two[p : p + rng.randrange(2)] = rng.choice([[], [1000 + rng.randrange(9)]])
        if len(two) >= MIN_WORDS and jaccard(one, two) >= 0.75:
            longest = best = 0
            at = {x: i for i, x in enumerate(one)}
            for x, y in zip([None, *two], two):
                longest = longest + 1 if x in at and at.get(y) == at[x] + 1 else int(y in at)
                best = max(best, longest)
            assert best >= INTACT


@pytest.mark.parametrize("edited", [False, True])
def test_recall_at_every_length(spark, edited):
    """Copies of 20 words and more between unrelated words, equal or with up to three words changed, lost or added."""
    rng = random.Random(11)
    rows, pairs = [], []
    for n in (20, 21, 24, 27, 30, 36, 39, 41, 51, 60, 80, 120):
        made = 0
        while made < 12:
            one = words(rng, n)
            two = list(one)
            for _ in range(rng.choice([1, 1, 2, 3]) if edited else 0):
                p = rng.randrange(len(two))
                two[p : p + rng.randrange(2)] = rng.choice([[], words(rng, 1)])
            if len(two) >= MIN_WORDS and jaccard(one, two) >= 0.75:
                made += 1
                pairs.append((len(rows), len(rows) + 1))
                rows += [(len(rows) + k, " ".join(words(rng, 60) + x + words(rng, 60))) for k, x in enumerate((one, two))]
    found = {r.doc_id for r in run(spark, rows)}
    assert sum(a in found and b in found for a, b in pairs) >= 0.98 * len(pairs)


def test_first_place_of_a_signature_is_no_copy(spark):
    """Two documents share a passage of which every five words stand somewhere earlier, each in other surroundings."""
    rng = random.Random(12)
    p = words(rng, 24)
    rows = [(i, " ".join(words(rng, 30) + p[i : i + 5] + words(rng, 30))) for i in range(20)]
    rows += [(50 + i, " ".join(words(rng, 40) + p + words(rng, 40))) for i in range(3)]
    assert {r.doc_id: r.cluster_id for r in run(spark, rows)} == {50: 50, 51: 50, 52: 50}


def test_repeats_of_short_periods(spark):
    """A phrase of one to four words said over and over is cut, so it is found in whatever stands round it."""
    rng = random.Random(6)
    rows = []
    for k in range(1, 5):
        phrase = words(rng, k)
        for i in range(6):
            rows.append((10 * k + i, " ".join(words(rng, 40 + i) + (phrase * 60)[:60] + words(rng, 40))))
    assert {r.doc_id for r in run(spark, rows)} == {i for i, _ in rows}


def test_short_passages_with_an_edited_word(spark):
    """One changed, lost or added word in the middle of 51 leaves a passage of Jaccard 0.75 or more."""
    rng = random.Random(8)
    rows, lost = [], []
    for k in range(60):
        one = words(rng, 51)
        two = one[:25] + [words(rng, 1), [], words(rng, 1) + one[25:26]][k % 3] + one[26:]
        rows += [(2 * k + i, " ".join(words(rng, 100) + x + words(rng, 100))) for i, x in enumerate((one, two))]
    found = {r.doc_id for r in run(spark, rows)}
    lost = [i for i, _ in rows if i not in found]
    assert len(lost) <= 2


def test_extended():
    rng = random.Random(9)
    p, far = ([rng.randrange(2**32) for _ in range(n)] for n in (60, 200))
    one, two = far[:50] + p + far[50:100], far[100:150] + p[:30] + [7] + p[31:] + far[150:]
    assert extended(one, two, 60, 60, 9, 20) == (50, 110, 50, 110)
    assert extended(one, two, 60, 60, 9, 61) is None
    # an edit every ten words is below the threshold as a whole, and each stretch is too short
    worn = [x if i % 10 else i for i, x in enumerate(p)]
    assert extended(one, far[100:150] + worn + far[150:], 61, 61, 9, 20) is None
