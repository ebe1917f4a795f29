import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import chat

pieces = st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|", ">", "s", "/", "é", "\n", "INST]", "<\\s>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(pieces, max_size=6).map("".join), st.lists(pieces, max_size=12).map("".join)), max_size=4))
def test_round_trip(turns):
    formatted, _ = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    for role, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_sql(spark, sf_dir):
    extra = [(7000, None, None, None), (7000, 3, "assistant", "a\\<s>[INST]"), (7000, 3, "assistant", "a\\<s>[INST]"), (7001, 0, "assistant", None), (None, 1, "user", "x"), (None, 0, "assistant", "y")]
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    df = df.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    pdf = df.toPandas()
    con.sql("create table conversations as select conv_id::bigint conv_id, turn::bigint turn, role, text from pdf where conv_id is null or conv_id < 7000")
    con.execute("insert into conversations values (7000,null,null,null),(7000,3,'assistant','a\\<s>[INST]'),(7000,3,'assistant','a\\<s>[INST]'),(7001,0,'assistant',null)")
    want = con.sql(chat.READ_BACK_SQL.replace("order by turn, role", "order by turn nulls first, role")).fetchall()
    got = [tuple(r) for r in chat.conversation_digests(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_branches(spark):
    rng = random.Random(3)
    rows, by = [], {}
    for tree in range(3):
        for m in range(1, 40):
            parent = rng.choice([p for p in range(1, m)] or [None]) if m > 1 else None
            score = rng.randrange(8) / 8
            rows.append((tree, m, parent, rng.choice(["user", "assistant"]), f"t{tree}m{m}", score))
            by[tree, m] = rows[-1]
    rows += [(9, 1, 2, "user", "loop", 1.0), (9, 2, 1, "user", "loop", 1.0), (9, 3, 2, "user", "on a loop", 1.0), (10, 5, 99, "user", "orphan", None)]
    by[10, 5] = rows[-1]
    df = spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double")
    want = []
    for tree in (0, 1, 2, 10):
        leaves = {m for t, m in by if t == tree} - {by[k][2] for k in by if k[0] == tree}
        ranked = []
        for leaf in leaves:
            path, m = [], leaf
            while (tree, m) in by:
                path.append(by[tree, m])
                m = path[-1][2]
            ranked.append((-sum(p[5] or 0 for p in path) / len(path), leaf, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(ranked)[:3], 1):
            want.append((tree, rank, chat.format_turns([(p[3], p[4]) for p in path])[0]))
    got = [(r.tree, r["rank"], r.formatted) for r in chat.format_trees(df, 3).collect()]
    assert sorted(got) == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.conversation_digests(df).collect()] == [-1]


def test_long_texts_and_other_columns(spark):
    """Texts of a million characters, and columns named as those used inside."""
    long = "<s> é\\" * 200_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), (2, 0, "assistant", "")]
    names = ("tree", "msg", "parent", "score", "formatted", "rank", "leaf", "pos")
    df = spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{n}` int" for n in names))
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(map(tuple, chat.conversation_digests(df).collect())) == sorted(con.sql(chat.READ_BACK_SQL).fetchall())
