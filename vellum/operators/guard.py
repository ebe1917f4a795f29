"""The older, independent lock: numbers, citations, terms, headings, lengths and n-gram overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import text as T
from vellum.operators.lock import differences

MIN_RETENTION, MAX_EXPANSION = 0.55, 1.80
HEADING = r"(?Udm)^\s{0,3}#{1,6}\s+(.+?)\s*$"


def item(value: Column) -> Column:
    return T.sub(T.squeeze(value), r"[.,;:，。；：]+$", "")


def numbers(text: Column) -> Column:
    return F.transform(T.find_all(text, P.GUARD_NUMBER), item)


def citations(text: Column) -> Column:
    """All patterns independently: one citation may count under two."""
    return F.transform(F.concat(*(T.find_all(text, p) for p in P.GUARD_CITATIONS)), item)


def items(pairs: DataFrame, kinds: tuple[str, ...] = ("numbers", "citations")) -> DataFrame:
    of = {"numbers": numbers, "citations": citations}
    parts = [F.struct(F.lit(k).alias("category"), F.lit(s).alias("side"), of[k](F.coalesce(c, F.lit(""))).alias("v")) for k in kinds for c, s in (("before", -1), ("after", 1))]
    rows = pairs.select("doc_id", F.explode(F.array(*parts)).alias("x"))
    return rows.select("doc_id", "x.category", "x.side", F.explode("x.v").alias("value"))


def guard_items(pairs: DataFrame, kind: str) -> DataFrame:
    return differences(items(pairs, (kind,))).where("n_before <> n_after")


def templates(pairs: DataFrame) -> DataFrame:
    """doc_id, phrase, n_before, n_after; overlapping phrases are counted independently."""
    low = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    rows = pairs.select("doc_id", low("before").alias("b"), low("after").alias("a"))
    found = F.array(*(F.struct(F.lit(p).alias("phrase"), T.occurrences(F.col("b"), F.lit(p)).alias("n_before"), T.occurrences(F.col("a"), F.lit(p)).alias("n_after")) for p in P.TEMPLATES))
    return rows.select("doc_id", F.explode(F.filter(found, lambda x: x["n_before"] + x["n_after"] > 0)).alias("x")).select("doc_id", "x.*")


def term_mismatches(pairs: DataFrame, terms: list[str]) -> DataFrame:
    found = F.array(*(F.struct(F.lit(t).alias("term"), T.occurrences(F.coalesce("before", F.lit("")), F.lit(t)).alias("n_before"), T.occurrences(F.coalesce("after", F.lit("")), F.lit(t)).alias("n_after")) for t in terms))
    return pairs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*").where("n_before <> n_after")


def _lengths(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), T.solid_length), lambda n: n > 0)


def lengths(pairs: DataFrame) -> DataFrame:
    """Sentence and paragraph lengths in solid characters, before and after: counts, sums, sums of squares, extremes (0 if there are none)."""
    out = [F.col("doc_id")]
    for side in ("before", "after"):
        text = F.coalesce(side, F.lit(""))
        for kind, pattern in (("sentence", r"(?U)(?<=[.!?。！？])\s+|[；;]+"), ("paragraph", r"(?U)\n\s*\n+")):
            v = _lengths(text, pattern)
            name = f"{side}_{kind}"
            out += [
                F.size(v).cast("long").alias(f"{name}_n"), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias(f"{name}_sum"), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x * x).alias(f"{name}_squares"),
                F.coalesce(F.array_min(v), F.lit(0)).alias(f"{name}_min"), F.coalesce(F.array_max(v), F.lit(0)).alias(f"{name}_max"),
            ]
    return pairs.select(*out)


def _grams(text: Column, char: Column) -> Column:
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    none = F.array().cast("array<string>")
    by_char = T.let(T.sub(low, r"(?U)[\s\W_]+", ""), lambda t: T.char_grams(t, 6))
    words = T.find_all(low, r"[a-z]+(?:[-'][a-z]+)*|\p{Nd}+(?:\.\p{Nd}+)?")
    by_word = T.let(words, lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.array_join(F.slice(w, i, 5), " "))).otherwise(none))
    return F.array_distinct(F.when(char, by_char).otherwise(by_word))


def overlap(pairs: DataFrame) -> DataFrame:
    """doc_id, mode, original_ngrams, revised_ngrams, shared_ngrams, jaccard, original_recall."""
    b, a = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    compact = T.sub(F.concat(b, a), r"(?U)\s+", "")
    char = (F.length(compact) > 0) & (T.cjk_count(compact) / F.length(compact) >= 0.20)
    rows = pairs.select("doc_id", b.alias("b"), a.alias("a"), char.alias("char"))
    rows = rows.select("doc_id", "char", _grams(F.col("b"), F.col("char")).alias("x"), _grams(F.col("a"), F.col("char")).alias("y"))
    rows = rows.select("doc_id", "char", F.size("x").cast("long").alias("original_ngrams"), F.size("y").cast("long").alias("revised_ngrams"), F.size(F.array_intersect("x", "y")).cast("long").alias("shared_ngrams"))
    union = F.col("original_ngrams") + F.col("revised_ngrams") - F.col("shared_ngrams")
    share = lambda n: F.when(n > 0, F.col("shared_ngrams") / n).otherwise(1.0)
    return rows.select("doc_id", F.when(F.col("char"), "6-character").otherwise("5-word").alias("mode"), "original_ngrams", "revised_ngrams", "shared_ngrams", share(union).alias("jaccard"), share(F.col("original_ngrams")).alias("original_recall"))


def blockers(pairs: DataFrame, terms: list[str] = (), min_retention: float = MIN_RETENTION, max_expansion: float = MAX_EXPANSION) -> DataFrame:
    """doc_id, original_units, revised_units, blockers (in order, joined by '; '), status."""
    found = differences(items(pairs)).groupBy("doc_id")
    sums = found.agg(*(F.sum(F.when(F.col("category") == k, F.col(c)).otherwise(0)).alias(f"{k}_{c}") for k in ("numbers", "citations") for c in ("removed", "added")))
    b, a = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    differ = F.lit(False)
    for t in terms:
        differ = differ | (T.occurrences(b, F.lit(t)) != T.occurrences(a, F.lit(t)))
    heads = T.find_all(b, HEADING, 1)
    rows = pairs.select("doc_id", T.solid_length(b).alias("original_units"), T.solid_length(a).alias("revised_units"), differ.alias("terms"), ((F.size(heads) > 0) & (heads != T.find_all(a, HEADING, 1))).alias("headings")).join(sums, "doc_id", "left")
    ratio = F.when(F.col("original_units") > 0, F.col("revised_units") / F.col("original_units")).otherwise(1.0)
    rules = (
        (F.coalesce("numbers_removed", F.lit(0)) > 0, "numbers removed or changed"), (F.coalesce("numbers_added", F.lit(0)) > 0, "numbers added or changed"),
        (F.coalesce("citations_removed", F.lit(0)) > 0, "citations removed or changed"), (F.coalesce("citations_added", F.lit(0)) > 0, "citations added or changed"),
        (F.col("terms"), "protected-term counts changed"), (F.col("headings"), "Markdown heading text/order changed"),
        (ratio < min_retention, f"length retention below {min_retention:.2f}"), (ratio > max_expansion, f"length expansion above {max_expansion:.2f}"),
    )
    listed = F.array_join(F.filter(F.array(*(F.when(c, m) for c, m in rules)), lambda x: x.isNotNull()), "; ")
    return rows.select("doc_id", "original_units", "revised_units", listed.alias("blockers")).withColumn("status", F.when(F.col("blockers") == "", "PASS").otherwise("FAIL"))
