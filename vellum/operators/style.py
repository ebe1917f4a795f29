"""Descriptive measures of one document's style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import text as T

MIN_TOKENS, MAX_ITEMS = 4, 10


def _cleaned(docs: DataFrame, suffix: str = ".txt") -> DataFrame:
    return docs.select("doc_id", T.clean(F.col("text"), suffix).alias("t"))


def token_table(docs: DataFrame) -> DataFrame:
    tokens = T.tokens(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


def units_and_language(docs: DataFrame) -> DataFrame:
    rows = _cleaned(docs).withColumn("language", T.language(F.col("t")))
    return rows.select("doc_id", "language", T.units(F.col("t"), F.col("language")).alias("units"), T.cjk_count(F.col("t")).alias("cjk"), T.word_count(F.col("t")).alias("words"))


def sentence_table(docs: DataFrame) -> DataFrame:
    rows = _cleaned(docs).select("doc_id", T.paragraphs(F.col("t"), MIN_TOKENS).alias("p"))
    rows = rows.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.flatten(F.transform("p", T.sentences)).alias("s"))
    return rows.select("doc_id", "n_paragraphs", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


def _sizes(array: Column) -> Column:
    return F.transform(array, lambda x: F.size(T.tokens(x)).cast("long"))


def describe(docs: DataFrame) -> DataFrame:
    """Sentence and paragraph lengths in tokens: exact sums (mean, population deviation and cv follow), median, and the variation signal on the unrounded cv."""
    rows = _cleaned(docs).select("doc_id", T.paragraphs(F.col("t"), MIN_TOKENS).alias("p"))
    rows = rows.select("doc_id", _sizes(F.col("p")).alias("paragraph"), _sizes(F.flatten(F.transform("p", T.sentences))).alias("sentence"))
    out = [F.col("doc_id")]
    for c in ("sentence", "paragraph"):
        n = F.size(c).cast("long")
        total = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        squares = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x * x)
        ordered = F.sort_array(c)
        middle = F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))
        cv = F.when((n > 0) & (total > 0), F.sqrt((n * squares - total * total).cast("double")) / total)
        out += [n.alias(f"{c}_n"), total.alias(f"{c}_sum"), squares.alias(f"{c}_squares"), F.array_min(c).alias(f"{c}_min"), F.array_max(c).alias(f"{c}_max"), middle.alias(f"{c}_median_x2"), T.variation(cv, n).alias(f"{c}_variation")]
    return rows.select(*out)


def lexical(docs: DataFrame) -> DataFrame:
    tokens = F.transform(T.tokens(F.col("t")), F.lower)
    rows = _cleaned(docs).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("unique_tokens"))
    some = F.col("n_tokens") > 0
    return rows.select("*", F.when(some, F.col("unique_tokens") / F.col("n_tokens")).alias("type_token_ratio"), F.when(some, F.col("unique_tokens") / F.sqrt(F.col("n_tokens").cast("double"))).alias("root_ttr"))


PUNCTUATION = ("dashes", "semicolons", "colons", "parenthetical_pairs")


def _punctuation(t: Column) -> list[Column]:
    count = lambda s: T.occurrences(t, F.lit(s))
    found = (
        T.count_all(t, r"—|–|(?<!-)--(?!-)"),
        count(";") + count("；"),
        count(":") + count("："),
        F.least(count("("), count(")")) + F.least(count("（"), count("）")),
    )
    return [c.alias(name) for name, c in zip(PUNCTUATION, found, strict=True)]


def punctuation(docs: DataFrame) -> DataFrame:
    return _cleaned(docs).select("doc_id", *_punctuation(F.col("t")))


def density(count: Column, tokens: Column) -> Column:
    """A count for every thousand tokens, unrounded; 0 without tokens."""
    return F.when(tokens > 0, count * 1000.0 / tokens).otherwise(0.0)


def punctuation_per_thousand(docs: DataFrame) -> DataFrame:
    n = F.size(T.tokens(F.col("t"))).cast("long").alias("n_tokens")
    rows = _cleaned(docs).select("doc_id", n, *_punctuation(F.col("t")))
    return rows.select("doc_id", "n_tokens", *(density(F.col(c), F.col("n_tokens")).alias(f"{c}_per_thousand") for c in PUNCTUATION))


def _top(rows: DataFrame, first: str, k: int = MAX_ITEMS) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), first)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def openings(docs: DataFrame) -> DataFrame:
    """Sentence openings that a document repeats: the most frequent ones, ties to the first seen, then those that come twice or more."""
    return _openings(docs, T.all_sentences(F.col("t"), MIN_TOKENS), 4, 3)


def paragraph_openings(docs: DataFrame) -> DataFrame:
    """The same of paragraphs, one word wider."""
    return _openings(docs, T.paragraphs(F.col("t"), MIN_TOKENS), 5, 4)


def _openings(docs: DataFrame, parts: Column, zh_width: int, width: int) -> DataFrame:
    rows = _cleaned(docs).withColumn("zh", T.language(F.col("t")) == "zh")
    rows = rows.select("doc_id", "zh", F.posexplode(parts).alias("pos", "s"))
    rows = rows.withColumn("w", F.transform(T.tokens(F.col("s")), F.lower)).withColumn("width", F.when(F.col("zh"), zh_width).otherwise(width))
    rows = rows.where(F.size("w") >= F.greatest(F.col("width") + 2, F.lit(5)))
    opening = F.array_join(F.slice("w", F.lit(1), F.col("width")), "\x01")
    rows = rows.select("doc_id", "pos", "s", F.when(F.col("zh"), F.translate(opening, "\x01", "")).otherwise(F.translate(opening, "\x01", " ")).alias("opening"))
    counted = rows.groupBy("doc_id", "opening").agg(F.count("*").alias("n"), F.min(F.struct("pos", "s")).alias("first"))
    top = _top(counted.withColumn("pos", F.col("first.pos")), "pos").where("n >= 2")
    return top.select("doc_id", "opening", "n", F.substring("first.s", 1, 180).alias("example"))


def trigrams(docs: DataFrame) -> DataFrame:
    """Word trigrams with a content word that stand three times or more, over sentence bounds."""
    words = F.transform(T.words(F.col("t")), F.lower)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.slice("w", i + 1, 3))
    rows = _cleaned(docs).where(T.language(F.col("t")) != "zh").select("doc_id", words.alias("w")).where("size(w) >= 3")
    rows = rows.select("doc_id", F.posexplode(grams).alias("pos", "g")).where(F.exists("g", lambda x: ~x.isin(*sorted(P.STOPWORDS))))
    counted = rows.groupBy("doc_id", F.array_join("g", " ").alias("phrase")).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return _top(counted.where("n >= 3"), "pos").select("doc_id", "phrase", "n")


def cjk_phrases(docs: DataFrame) -> DataFrame:
    """Repeated phrases of 4 to 10 CJK characters, longer ones first at equal counts, none inside a chosen one with as many."""
    compact = F.array_join(T.find_all(F.col("t"), T.CJK), "")
    rows = _cleaned(docs).where(T.language(F.col("t")) == "zh").select("doc_id", compact.alias("c"))
    grams = F.transform(F.sequence(F.lit(1), F.size("chars") - F.col("k") + 1), lambda i: F.array_join(F.slice("chars", i, F.col("k")), ""))
    edge = rf"^[{P.ZH_FUNCTION}]|[{P.ZH_FUNCTION}]$"
    # one length at a time, so no row holds the grams of all
    sized = rows.select("doc_id", F.split("c", "").alias("chars"), F.explode(F.sequence(F.lit(4), F.lit(10))).alias("k")).where("size(chars) >= k")
    counted = sized.select("doc_id", F.explode(grams).alias("g")).where(~F.col("g").rlike(edge)).groupBy("doc_id", "g").agg(F.count("*").alias("n")).where("n >= 3")
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.length("g")).alias("l"), "g")))

    def choose(chosen: Column, x: Column) -> Column:
        inside = F.exists(chosen, lambda c: F.contains(c["g"], x["g"]) & (x["n"] >= c["n"]))
        return F.when(inside | (F.size(chosen) >= MAX_ITEMS), chosen).otherwise(F.concat(chosen, F.array(x)))

    empty = F.expr("cast(array() as array<struct<n: bigint, l: int, g: string>>)")
    return counted.groupBy("doc_id").agg(F.aggregate(order, empty, choose).alias("x")).select("doc_id", F.posexplode("x").alias("rank", "x")).select("doc_id", "rank", F.col("x.g").alias("phrase"), (-F.col("x.n")).alias("n"))


def _labelled(rows: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    """doc_id, label, n for the labels that occur."""
    pairs = F.array(*(F.struct(F.lit(label).alias("label"), count.alias("n")) for label, count in columns))
    return rows.select("doc_id", F.explode(F.filter(pairs, lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.label", "x.n")


def stock_phrases(docs: DataFrame) -> DataFrame:
    rows = _cleaned(docs).withColumn("lang", T.language(F.col("t")))
    of = lambda lang, p: F.when(F.col("lang") != lang, T.count_all(F.col("t"), rf"(?isU){p}")).otherwise(0)
    found = _labelled(rows, [(label, of("zh", p)) for label, p in P.STOCK_EN] + [(label, of("en", p)) for label, p in P.STOCK_ZH])
    return _top(found, "label").select("doc_id", "label", "n")


def term_counts(docs: DataFrame) -> DataFrame:
    """Transitions, hedges and boosters: doc_id, kind, term, n."""
    rows = _cleaned(docs).withColumn("lang", T.language(F.col("t")))
    out = []
    for kind in P.TERMS_EN:
        en = [(t, F.when(F.col("lang") != "zh", T.count_all(F.col("t"), rf"(?iU)\b\Q{t}\E\b")).otherwise(0)) for t in P.TERMS_EN[kind]]
        zh = [(t, F.when(F.col("lang") != "en", T.occurrences(F.col("t"), F.lit(t))).otherwise(0)) for t in P.TERMS_ZH[kind]]
        pairs = F.filter(F.array(*(F.struct((-n).alias("m"), F.lit(t).alias("term")) for t, n in en + zh)), lambda x: x["m"] < 0)
        out.append(F.transform(F.slice(F.array_sort(pairs), 1, MAX_ITEMS), _kind(kind)))
    return rows.select("doc_id", F.explode(F.concat(*out)).alias("x")).select("doc_id", "x.kind", "x.term", "x.n")


def _kind(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["term"].alias("term"), (-x["m"]).cast("long").alias("n"))


def triads(docs: DataFrame) -> DataFrame:
    """Sentences that may list three things: doc_id, pos, sentence (220 characters)."""
    rows = _cleaned(docs).withColumn("lang", T.language(F.col("t")))
    rows = rows.select("doc_id", "lang", F.posexplode(T.all_sentences(F.col("t"), MIN_TOKENS)).alias("pos", "s"))
    hit = ((F.col("lang") != "en") & F.col("s").rlike(P.TRIAD_ZH)) | ((F.col("lang") != "zh") & F.col("s").rlike(f"(?iU){P.TRIAD_EN}"))
    return rows.where(hit).select("doc_id", F.col("pos").cast("long").alias("pos"), F.substring("s", 1, 220).alias("sentence"))


def clean_pages(pages: DataFrame) -> DataFrame:
    t = T.clean(F.col("html"), ".md")
    return pages.select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5"))
