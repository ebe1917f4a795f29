import random

from vellum.llm.components import components


def brute(edges):
    label = {}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            label.setdefault(x, x)
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in label)


def test_components(spark):
    rng = random.Random(1)
    chain = [(i + 1, i) for i in range(100, 260)]
    star = [(1000, i) for i in range(1001, 1200)]
    loose = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    for edges in ([], [(1, 1), (None, 2)], [(5, 3), (3, 5)], chain + star + loose):
        df = spark.createDataFrame(edges, "a long, b long")
        assert sorted(tuple(r) for r in components(df).collect()) == brute(edges)
