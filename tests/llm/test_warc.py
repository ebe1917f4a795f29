import hashlib

import duckdb

from vellum.llm.warc import ROUND_TRIP_SQL, archive_round_trip, parse


def brute(rows):
    best, count = {}, {}
    for p, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            count[b] = count.get(b, 0) + 1
            if p is not None:
                best[b] = max(p, best.get(b, p))
    out = []
    for p, h in rows:
        b = (h or "").encode()
        to = best.get(b) if count.get(b, 0) > 1 else None
        to = None if to == p else to
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(p, "http://x/\r\n%s" % p if p != 3 else None, h, "z") for p, h in rows], "page_id long, url string, html string, digest string")
    return sorted((tuple(r) for r in archive_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_edges(spark):
    big, odd = "x" * 1000, "é" * 499 + "a"
    trap = "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 60
    rows = [(1, big), (2, big), (9, big), (4, "short"), (5, "short"), (6, None), (7, ""), (8, odd), (10, odd + "b"), (11, odd + "b"), (3, trap), (12, trap), (None, big), (13, "\n\r\n" * 400), (20, "y" * 3_000_000)]
    rows += [(100 + i, "q" * 2000) for i in range(50)] + [(30, big)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_sql(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ours = sorted(tuple(r) for r in archive_round_trip(pages).collect())
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert ours == sorted(con.sql(ROUND_TRIP_SQL).fetchall())


def test_parse_in_small_parts():
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    for step in (1, 2, 7, 1000):
        got = list(parse(iter([raw[i : i + step] for i in range(0, len(raw), step)])))
        assert [b for _, b in got] == [b"abc", b""]
