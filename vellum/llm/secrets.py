"""Secret scans over whole texts by way of a trigram inverted index; DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams is derived: what
every match must contain.  The index holds, for the trigrams of all queries,
which documents have them; clauses are answered by intersecting postings
(counting a clause's trigrams per document), and only the documents left are
searched with the expression.  A rule of which no trigram is mandatory scans
every text.

Spans are leftmost and don't overlap within a kind; they are code points with
an exclusive end.

Defined cases: a null or empty text has no spans; repeated rows and repeated
ids each give their own row; a null doc_id is scanned and kept; spans that begin
at one place are in the order of the rules; an empty table gives no rows; very
long texts are scanned whole; other columns play no part.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.workspace import materialize, sized


@dataclass(frozen=True)
class Rule:
    """pattern: understood alike by Java, RE2 and Python; a match is kept if group has min_length characters."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
EXTRA = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + EXTRA

#: More alternatives than this are not told apart.
_MOST = 48


class _Literals:
    """What a piece of an expression can match: exactly these strings (None: too many), and clauses every match satisfies."""

    def __init__(self, exact: set[str] | None, query: list[frozenset[frozenset[str]]]):
        self.exact, self.query = exact, query


def _grams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _settle(strings: set[str]) -> list[frozenset[frozenset[str]]]:
    """One of these strings stands in the match: a choice of trigram sets, if each has one."""
    options = frozenset(_grams(s) for s in strings)
    return [] if any(not o for o in options) else [options]


def _walk(tree) -> _Literals:
    exact: set[str] | None = {""}
    query: list[frozenset[frozenset[str]]] = []
    for op, arg in tree:
        part = _step(op, arg)
        query += part.query
        if part.exact is not None and exact is not None and len(exact) * len(part.exact) <= _MOST:
            exact = {a + b for a, b in product(exact, part.exact)}
            continue
        if exact is not None:
            query += _settle(exact)
        exact = part.exact if part.exact is not None else None
        if exact is None:
            exact = {""}
            closed = True
        else:
            closed = False
        if closed and len(tree) == 1:
            return _Literals(None, query)
    return _Literals(exact, query) if not query else _Literals(None, query + _settle(exact or {""}))


def _step(op, arg) -> _Literals:
    if op is sre.LITERAL:
        return _Literals({chr(arg)}, [])
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(p.exact is not None for p in parts):
            return _Literals(set().union(*(p.exact for p in parts)), [])
        return _Literals(None, [])
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
        return _Literals({chr(c) for _, c in arg}, [])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        part = _walk(inner)
        if part.exact is not None and high is not sre.MAXREPEAT and high <= 1:
            return _Literals(part.exact | {""} if low == 0 else part.exact, [])
        if low == 0:
            return _Literals(None, [])
        return _Literals(None, part.query + (_settle(part.exact) if part.exact is not None else []))
    return _Literals(None, [])


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams: every match contains all of one of them.  Empty: no trigram is mandatory.

    Of all choices that every match satisfies, the one with the longest shortest alternative is taken.
    """
    tree = _walk(sre_parser.parse(pattern))
    query = tree.query or (_settle(tree.exact) if tree.exact else [])
    if not query:
        return []
    best = max(query, key=lambda q: (min(len(o) for o in q), -len(q)))
    return sorted((o for o in best if not any(x < o for x in best)), key=sorted)


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(key, text) -> key, mask: bits of the rules with a trigram query that the document's trigrams satisfy."""
    spark = docs.sparkSession
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for o in q for g in o})
    clauses = [(n, grams.index(g), len(o)) for n, (_, o) in enumerate((i, o) for i, q in enumerate(queries) for o in q) for g in sorted(o)]
    bits = [1 << i for i, q in enumerate(queries) for _ in q]
    low = F.lower("text")
    index = docs.select("key", low.alias("low")).select("key", F.explode(F.filter(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))), lambda x: x.isNotNull())).alias("gram")).distinct()
    of = F.broadcast(spark.createDataFrame([(c, g, n, bits[c]) for c, g, n in clauses], "clause int, gram int, size int, bit long"))  # a few rows for each rule
    met = index.join(of, "gram").groupBy("key", "clause", "size", "bit").agg(F.count("*").alias("n")).where("n = size")
    return met.groupBy("key").agg(F.bit_or("bit").alias("mask"))


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's kept matches in a text."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lengths = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))
    placed = F.aggregate(
        lengths,
        empty,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    long_enough = F.filter(F.zip_with(placed, kept, lambda s, k: F.struct(s.alias("s"), F.length(k).alias("n"))), lambda x: x["n"] >= rule.min_length)
    return F.transform(long_enough, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end")))


def _ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _number(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents(doc_id, text) -> doc_id, secrets: array<struct<start, rank, end, kind>> by start, then rule; one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    found = sized(materialize(candidates(keyed, rules), "candidates"))
    rows = keyed.join(found, "key", "left")
    none = F.expr("cast(array() as array<struct<start: int, rank: int, end: int, kind: string>>)")
    parts = []
    for i, rule in enumerate(rules):
        worth = F.coalesce(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False)) if trigram_query(rule.pattern) else F.lit(True)
        parts.append(F.when(worth & F.col("text").rlike(rule.pattern), _ranked(_spans(F.col("text"), rule), i, rule.kind)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("secrets"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    counts = [_number(r.kind).alias(f"n_{r.kind}") for r in BASE]
    return find_secrets(docs).select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def secret_digest_sql() -> str:
    """DuckDB SQL for secret_digest over documents."""
    parts = []
    for rank, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(
            f"""select r, {rank} as rank, '{rule.kind}' as kind, pos as start, pos + m as stop from (
  select r, unnest(k) as k, unnest(n) as m, unnest(list_transform(range(1, len(n) + 1), lambda i: coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(n[1:i-1]), 0)))::bigint as pos
  from (select r, list_transform(regexp_extract_all(t, '{p}', {rule.group}), lambda x: length(x)) as k,
               list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) as n,
               list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) as g from d)
) where k >= {rule.min_length}"""
        )
    union = "\nunion all\n".join(parts)
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as ({union})
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < {len(BASE)}), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (kind is not null), '') as spans
from d left join s using (r) group by d.r, d.doc_id"""
