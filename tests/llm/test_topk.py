import math
import random

import duckdb

from vellum.llm.topk import NEIGHBOURS_SQL, embedding_neighbours


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ok) if m != n and len(b) == len(a))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1.5) for i, v in rows], "vec_id long, embedding array<float>, score double")
    return sorted(tuple(r) for r in embedding_neighbours(df).collect())


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = sorted(tuple(r) for r in embedding_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect())
    assert got == sorted(con.sql(NEIGHBOURS_SQL).fetchall())


def test_edges(spark):
    rng = random.Random(5)
    near = lambda: [rng.randrange(-40, 40) / 16 for _ in range(4)]
    rows = [(i, near()) for i in range(450)] + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]
    rows += [(2000, None), (2100, [1.0, None, 0.0, 0.0]), (2200, [float("nan")] * 4), (2300, [float("inf"), 0.0, 0.0, 0.0]), (None, near()), (2400, [1.0, 2.0]), (2401, [3.0, 4.0]), (2500, []), (2501, []), (2600, [2.0**40, -(2.0**41), 1.0, 0.0]), (2601, [2.0**40, 2.0**13, 1.0, 0.0])]
    rows = [(i, v) for i, v in rows if i not in (2600, 2601)]
    assert run(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = [(0, [2.0**20, -(2.0**20) + 1, 3.0]), (1, [2.0**20, 2.0**20, 1.0]), (2, [2.0**20 + 1, 2.0**20, 1.0]), (3, [1e37, 1e37, 1e37])]
    got = run(spark, rows)
    assert [(a, b, c, min(s, 2**63 - 1)) for a, b, c, s in brute(rows)] == got


def test_empty_and_few(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0]), (100, [2.0])]) == [(0, 1, 100, 2 * 1024 * 1024), (100, 1, 0, 2 * 1024 * 1024)]


def test_repeated_ids(spark):
    """Rows are told apart by place: others of a query's id are its candidates, and each is a query."""
    rng = random.Random(6)
    rows = [(i % 150, [rng.randrange(-9, 9) / 8 for _ in range(3)]) for i in range(400)] + [(100, [1.0, 1.0, 1.0])] * 3
    got = run(spark, rows)
    assert got == brute(rows) and sum(q == 100 and i == 100 for q, _, i, _ in got) > 3


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr("vellum.llm.topk.SHARD_ROWS", 40)
    monkeypatch.setattr("vellum.llm.topk.BLOCK_VALUES", 20)
    rng = random.Random(7)
    rows = [(i, [rng.randrange(-50, 50) / 32 for _ in range(5)]) for i in range(900)]
    assert run(spark, rows) == brute(rows)
