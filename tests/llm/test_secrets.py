import hashlib
import re

import duckdb

from vellum.llm.secrets import BASE, RULES, secret_digest, secret_digest_sql, trigram_query


def spans(text, rules):
    found = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, re.ASCII):
            if len(m[r.group]) >= r.min_length:
                found.append((m.start(), rank, f"{r.kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(found))


def brute(rows):
    out = []
    for i, t in rows:
        t = t or ""
        base = spans(t, BASE)
        kinds = [x.split(":")[0] for x in base.split(",")]
        out.append((i, *(kinds.count(r.kind) for r in BASE), hashlib.sha256(base.encode()).hexdigest(), spans(t, RULES)))
    return sorted(out, key=str)


CASES = [
    None, "", "password=abcde", "PassWord : 'abcdef'", "api_key=ABCDEF token=123456;secret:x", "é😀 token = \"abcdefgh", "apikey=apikey=1234567", "password=\nabcdef",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 16, "x" + "0" * 23, "y" + "0123456789abcdef" * 3 + "g", "AF" + "a" * 24 + "AF" + "b" * 24,
    "token=" + "a" * 24, "ghp_" + "a" * 36, "GHP_" + "a" * 36, "xoxb-1234567890", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35, "passwd=secret=token=abcdefg",
    "secret" * 3000 + "=" + "f" * 5000, " ".join("token=abcdef%d" % i for i in range(3000)),
]


def run(spark, rows):
    return sorted((tuple(r) for r in secret_digest(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, mask string")).collect()), key=str)


def test_edges(spark):
    rows = list(enumerate(CASES)) + [(None, CASES[3]), (5, CASES[5]), (5, CASES[12])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = sorted(tuple(r) for r in secret_digest(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())
    assert got == sorted(con.sql(secret_digest_sql()).fetchall())


def test_trigram_queries_hold_for_every_match():
    for r in RULES:
        query = trigram_query(r.pattern)
        for text in CASES:
            for m in re.finditer(r.pattern, text or ""):
                assert not query or any(all(g in m[0].lower() for g in option) for option in query)
    assert trigram_query("[0-9a-f]{24,}") == []
    assert trigram_query("abc|de") == [] and trigram_query("(abcd|xyz)+q?") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]
