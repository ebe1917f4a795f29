import re

import pyarrow.parquet as pq

from vellum.llm import setjoin
from vellum.llm.ngram_join import ngram_components


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    has = {}
    for i, s in enumerate(sets):
        for g in s:
            has.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in has[g] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    out = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted([tuple(r) for r in out.collect()], key=str)


def test_against_brute_force(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "A\tB  c"), (6, "a b c d"), (7, " ".join(base)), (8, " ".join(base).upper()), (None, " ".join(base)), (7, " ".join(base))]
    rows += [(100 + i, " ".join(base[:i] + ["x%d" % i] + base[i + 1 :])) for i in range(30)]
    rows += [(300 + i, " ".join([f"v{i}_{j}" for j in range(40)] + base[:30])) for i in range(40)]  # a shared passage
    rows += [(400, " ".join(f"z{i}" for i in range(30000)))]
    assert run(spark, rows) == brute(rows)


def test_chain_across_leaders(spark):
    words = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 60])) for i in range(28)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, "x", "k"), (2, "a b c d e", 6, "y", "k")], "doc_id long, text string, label int, id string, key string")
    assert sorted(tuple(r) for r in ngram_components(df).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_near_copies_without_ids(spark):
    """A row without an id links like others: two documents that only it connects are one component."""
    w = [f"n{i}" for i in range(60)]
    rows = [(9, " ".join(w)), (None, " ".join(w[4:] + ["p0", "p1", "p2", "p3"])), (5, " ".join(w[8:] + [f"p{i}" for i in range(8)])), (None, "alone among all the rows here"), (None, None)]
    out = run(spark, rows)
    assert out == brute(rows)
    assert [c for d, _, c in out if d in (5, 9)] == [5, 5]


def test_crowds_that_share_a_key(spark):
    """Two large groups and many single documents share frequent words, so tiles have members of several components."""
    common = [f"s{i}" for i in range(14)]
    rows = []
    for g in range(2):
        base = [f"g{g}_{i}" for i in range(40)]
        for i in range(25):
            own = list(base)
            own[i] = f"e{g}_{i}"
            rows.append((g * 100 + i, " ".join(common + own)))
    rows += [(500 + i, " ".join(common + [f"u{i}_{j}" for j in range(6 + i % 4)])) for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_pairs_meet_once(spark, monkeypatch):
    """Sets that share many keys make one row in the tiles, not one for each key; none is lost where the carried keys are disjoint."""
    rows = [(k, i, i) for i in range(3) for k in range(100)] + [(k, 7, 7) for k in (-3, -2, -1, 50)] + [(k, 8, 8) for k in (-6, -5, -4, 50)]
    rows = spark.createDataFrame(rows, "key long, id long, label long")
    nodes = spark.createDataFrame([(i, 100, [0] * setjoin.WORDS) for i in (0, 1, 2, 7, 8)], "id long, n long, sig array<long>")
    want = [(a, b) for a in (0, 1, 2, 7, 8) for b in (0, 1, 2, 7, 8) if a < b]
    monkeypatch.setattr(type(rows), "distinct", lambda self: self)
    assert sorted(tuple(r) for r in setjoin._tiles(rows, nodes).collect()) == want
    monkeypatch.setattr(setjoin, "CARRIED", 3)
    assert sorted({tuple(r) for r in setjoin._tiles(rows, nodes).collect()}) == want
