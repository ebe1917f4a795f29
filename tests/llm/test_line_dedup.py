import math
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vellum.llm import line_dedup
from vellum.llm.line_dedup import dedup_lines


def tokens(line):
    w = [x for x in line.lower().split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """rows in order of id, then text."""
    seen, has, out = [], {}, []
    for key, text in rows:
        gone = []
        if text is not None:
            for at, line in enumerate(text.split("\n")):
                t = tokens(line)
                if not t:
                    continue
                near = {j for g in t for j in has.get(g, ())}
                if any(100 * len(t & seen[j]) >= 75 * len(t | seen[j]) for j in near):
                    gone.append(at)
                for g in t:
                    has.setdefault(g, []).append(len(seen))
                seen.append(t)
        out.append((key, None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), gone))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, line int, h string")
    return sorted(((r.doc_id, r.text, list(r.removed_lines)) for r in dedup_lines(df).collect()), key=str)


def test_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert run(spark, rows) == sorted(brute(sorted(rows)), key=str)


def test_edges(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:i] + ["x%d" % i] + base[i + 1 :]) for i in range(40)]
    rows = [(1, "A b\n\nc d e f g h\nC  d e F g h"), (2, None), (3, ""), (4, "a b"), (5, "\n".join(near[:20])), (6, "\n".join(near[20:]) + "\n"), (7, " \n \n"), (8, " ".join(f"z{i}" for i in range(20000)))]
    rows += [(10 + i, " ".join([f"v{i}_{j}" for j in range(20)] + base[:30])) for i in range(30)]
    rows += [(100 + i, " ".join(f"c{j}" for j in range(i * 4, i * 4 + 60))) for i in range(20)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_repeated_rows_nulls_and_empty(spark):
    text = "one two three four five six"
    assert run(spark, [(None, text), (5, text), (5, text)]) == sorted([(None, "", [0]), (5, text, []), (5, text, [])], key=str)
    assert run(spark, []) == []


def test_clashing_columns(spark):
    """Columns named as those used inside, and as the result's own, don't get in the way."""
    names = ("__d", "__h", "__gone", "d", "h", "gone", "line", "tokens", "row", "removed_lines", "a b.c")
    df = spark.createDataFrame([(1, "one two\none two", *range(11)), (2, "one two", *range(11))], ", ".join(["doc_id long", "text string", *(f"`{n}` int" for n in names)]))
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", *(n for n in names if n != "removed_lines"), "removed_lines"]
    assert sorted((r.doc_id, r.text, r.removed_lines, r["__gone"], r["a b.c"]) for r in out.collect()) == [(1, "one two", [1], 2, 10), (2, "", [0], 2, 10)]


def test_frequent_tokens(spark, sf_dir, monkeypatch):
    """With every token that three classes share taken for frequent, the same lines go."""
    monkeypatch.setattr("vellum.llm.line_dedup.CROWD", 3)
    test_against_brute_force(spark, sf_dir)
    test_edges(spark)


def test_large_tables_go_once_read(spark, monkeypatch):
    """Tables with tokens, prefixes or bitmaps are deleted while the operator runs; the others are there for the result."""
    made, gone = [], []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name="table", write=line_dedup.materialize: made.append((name, write(df, name))) or made[-1][1])
    monkeypatch.setattr(line_dedup, "discard", lambda table, delete=line_dedup.discard: gone.append(table) or delete(table))
    assert run(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g h i")]) == [(1, "a b c d e f g h", []), (2, "", [0]), (3, "", [0])]
    wide = [t for n, t in made if {"tokens", "prefix", "s0"} & set(t.columns) or n == "near"]
    assert len(wide) > 4 and all(any(t is g for g in gone) for t in wide)


def test_tokens_of_candidates_only(spark, monkeypatch):
    """No table holds the tokens of lines that share none, and of the others only those of pairs to verify are moved."""
    made = []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name="table", write=line_dedup.materialize: made.append((name, df.columns, write(df, name))) or made[-1][2])
    sizes = {}
    monkeypatch.setattr(line_dedup, "discard", lambda table, delete=line_dedup.discard: sizes.update({id(table): table.count()}) or delete(table))
    base = [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(f"u{i}_{j}" for j in range(20))) for i in range(50)]
    rows += [(60, " ".join(base)), (61, " ".join([*base, "x"])), (62, " ".join(base[:6])), (63, " ".join([*base[:6], *(f"z{j}" for j in range(20))]))]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    arrays = {name: sizes[id(t)] for name, columns, t in made if {"tokens", "set"} & set(columns)}
    assert arrays["tokens"] <= 4 and arrays["asked"] <= 2 and set(arrays) == {"tokens", "asked"}


def test_prefix(spark):
    """Where few or many of the first tokens are frequent, the prefix is the start of the whole order."""
    rng = random.Random(6)
    classes = bytes(rng.choice((0, 0, 0, 1, 5)) if i < line_dedup.SKETCH // 2 else 0 for i in range(line_dedup.SKETCH))
    sets = [sorted(rng.randrange(2**63) // 2**16 * 2**16 + rng.randrange(line_dedup.SKETCH // k) for _ in range(n)) for n in (*range(1, 40), 500) for k in (1, 2)]
    out = spark.createDataFrame([(x,) for x in sets], "t array<long>").select("t", line_dedup._prefix(F.col("t"), classes).alias("p")).collect()
    for r in out:
        whole = sorted(classes[t % line_dedup.SKETCH] << 58 | t >> 5 for t in r.t)
        assert r.p == whole[: len(r.t) - math.ceil(len(r.t) * 0.75) + 1]


def recorded(monkeypatch):
    """Names and rows of the tables that the operator makes, as they are when made."""
    made = []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name="table", write=line_dedup.materialize: (out := write(df, name), made.append((name, out.collect())))[0])
    return made


def test_lines_cut_once(spark, monkeypatch):
    """All lines are cut into tokens once; after that only the documents of classes that may be similar."""
    seen = []
    monkeypatch.setattr(line_dedup, "line_rows", lambda docs, cut=line_dedup.line_rows: seen.append(docs.count()) or cut(docs))
    rows = [(i, " ".join(f"u{i}_{j}" for j in range(20))) for i in range(20)] + [(30, "a b c d e f"), (31, "A b c d e f"), (32, "a b c d e f g h")]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert seen[0] == len(rows) and all(n < 3 for n in seen[1:])


def test_few_shared_tokens(spark, monkeypatch):
    """The tokens of lines that share one or two only aren't fetched; similar lines of any length are found."""
    made = recorded(monkeypatch)
    rows = [(i, " ".join(["s1 s2 s3 s4 s5", *(f"u{i}_{j}" for j in range(5))])) for i in range(6)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert [len(r) for name, r in made if name == "tokens"] == [0]
    rows = [(100 * n + k, " ".join([f"v{n}_{j}" for j in range(n + 4)] + ["x"] * k)) for n in range(1, 14) for k in range(5)]
    rows += [(5000 + n, " ".join(f"w{n}_{j}" for j in range(n))) for n in range(1, 6)] + [(6000 + n, " ".join(f"W{n}_{j}" for j in range(n))) for n in range(1, 6)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_frequent_beyond_the_head(spark, monkeypatch):
    """Lines mostly made of one passage don't meet at its tokens, wherever they stand in the hash order."""
    made = recorded(monkeypatch)
    rows = [(i, " ".join([f"p{j}" for j in range(40)] + [f"u{i}_{j}" for j in range(20)])) for i in range(40)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert max(len(r) for name, r in made if name == "lacking") == 40
    assert [len(r) for name, r in made if name == "near"] == [0]
