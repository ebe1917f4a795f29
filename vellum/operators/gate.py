"""The revision gate: sections matched between versions, retention, residue, move profiles and coded findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import text as T
from vellum.operators import segment


@dataclass(frozen=True)
class Limits:
    min_output_units: int | None = None
    min_overall_retention: float = 0.65
    min_section_retention: float = 0.50
    max_low_retention_sections: int = 0
    publication_ready: bool = False


def with_language(pairs: DataFrame, suffix: str = ".md") -> DataFrame:
    """The pairs with language (of both texts), move_language and the cleaned texts b and a."""
    rows = pairs.select("doc_id", "before", "after", T.clean(F.col("before"), suffix).alias("b"), T.clean(F.col("after"), suffix).alias("a"))
    rows = rows.withColumn("language", T.language(F.concat_ws("\n", "b", "a")))
    moves = F.when(F.col("language") != "mixed", F.col("language")).when(T.word_count(F.col("a")) >= T.cjk_count(F.col("a")), "en").otherwise("zh")
    return rows.withColumn("move_language", moves)


def document_facts(pairs: DataFrame, suffix: str = ".md") -> DataFrame:
    """doc_id, language, move_language, before_units, after_units."""
    rows = with_language(pairs, suffix)
    return rows.select("doc_id", "language", "move_language", T.units(F.col("b"), F.col("language")).alias("before_units"), T.units(F.col("a"), F.col("language")).alias("after_units"))


def grams(body: Column, lang: Column) -> Column:
    """Content grams of a section: CJK pairs and triples, or content words and pairs of them."""
    low, none = F.lower(body), F.array().cast("array<string>")
    zh = T.let(F.array_join(T.find_all(low, T.CJK), ""), lambda t: F.filter(F.concat(T.char_grams(t, 2), T.char_grams(t, 3)), lambda g: ~g.rlike(rf"^[{P.ZH_VECTOR_FUNCTION}]+$")))
    content = F.filter(T.words(low), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(P.VECTOR_STOPWORDS)))
    pairs = lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, 2), " "))).otherwise(none)
    return F.when(lang == "zh", zh).otherwise(T.let(content, lambda w: F.concat(w, pairs(w))))


def _versions(pairs: DataFrame) -> DataFrame:
    """doc_id, key, then title and body before and after (null where there is no such section), from one parse and one aggregation.

    One section for each key: the last; a title above others isn't one.
    """
    carry = [c for c in ("language",) if c in pairs.columns]
    plain = lambda array: F.filter(array, lambda s: ~((s["level"] == 1) & (F.size(array) > 1)))
    placed = lambda array, side: F.transform(array, lambda s, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), s["key"].alias("key"), s["level"].alias("level"), s["title"].alias("title"), s["body"].alias("body")))
    sides = [T.let(placed(segment.keyed_array(F.col(c)), c), plain) for c in ("before", "after")]
    rows = pairs.select("doc_id", *carry, F.explode(F.concat(*sides)).alias("s"))
    last = lambda side: F.max_by(F.when(F.col("s.side") == side, F.struct("s.title", "s.body")), F.when(F.col("s.side") == side, F.col("s.pos")))
    both = rows.groupBy("doc_id", F.col("s.key").alias("key"), *carry).agg(last("before").alias("b"), last("after").alias("a"))
    return both.select("doc_id", "key", *carry, F.col("b.title").alias("before_title"), F.col("b.body").alias("before_body"), F.col("a.title").alias("after_title"), F.col("a.body").alias("after_body"))


def section_retention(pairs: DataFrame) -> DataFrame:
    """doc_id, key, titles, units before and after, retention (unrounded; null if there was nothing)."""
    rows = _versions(with_language(pairs)).where("before_title is not null and after_title is not null")
    rows = rows.select("doc_id", "key", "before_title", "after_title", T.units(F.col("before_body"), F.col("language")).alias("before_units"), T.units(F.col("after_body"), F.col("language")).alias("after_units"))
    return rows.withColumn("retention", F.when(F.col("before_units") > 0, F.col("after_units") / F.col("before_units")))


def heading_changes(pairs: DataFrame) -> DataFrame:
    """doc_id, change (missing or added), title."""
    rows = _versions(pairs)
    missing = rows.where("after_title is null").select("doc_id", F.lit("missing").alias("change"), F.col("before_title").alias("title"))
    return missing.union(rows.where("before_title is null").select("doc_id", F.lit("added"), "after_title"))


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, gram, nb, na: content grams counted on both sides."""
    sides = rows.select(*by, F.explode(F.array(F.struct(F.lit(-1).alias("side"), grams(F.col("x"), F.col("language")).alias("g")), F.struct(F.lit(1).alias("side"), grams(F.col("y"), F.col("language")).alias("g")))).alias("s"))
    flat = sides.select(*by, "s.side", F.explode("s.g").alias("gram"))
    return flat.groupBy(*by, "gram").agg(F.sum(F.when(F.col("side") < 0, 1).otherwise(0)).alias("nb"), F.sum(F.when(F.col("side") > 0, 1).otherwise(0)).alias("na"))


def _chinese(pairs: DataFrame) -> DataFrame:
    """The pairs with language zh or other.  Cleaning takes characters away only, so texts that have few CJK ones needn't be cleaned to tell."""
    few = T.cjk_count(F.concat(*(F.coalesce(c, F.lit("")) for c in ("before", "after")))) < 10
    cleaned = T.language(F.concat_ws("\n", *(T.clean(F.col(c), ".md") for c in ("before", "after"))))
    return pairs.select("doc_id", "before", "after", F.when(few | (cleaned != "zh"), "other").otherwise("zh").alias("language"))


def _kept(x: Column, y: Column) -> Column:
    """How many of an array's grams another has too, as multisets.  One pass over both, sorted."""
    placed = lambda g, side: F.transform(g, lambda v: F.struct(v.alias("g"), F.lit(side).alias("side")))

    def step(s: Column, v: Column) -> Column:
        left = v["side"] == 0
        open_ = F.when(s["g"] == v["g"], s["n"]).otherwise(F.lit(0).cast("long"))
        met = ~left & (open_ > 0)
        return F.struct(v["g"].alias("g"), F.when(left, open_ + 1).when(met, open_ - 1).otherwise(open_).alias("n"), F.when(met, s["kept"] + 1).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(F.sort_array(F.concat(placed(x, 0), placed(y, 1))), F.expr("named_struct('g', cast(null as string), 'n', 0L, 'kept', 0L)"), step, lambda s: s["kept"])


def content_recall(pairs: DataFrame) -> DataFrame:
    """doc_id, key, retained, total, recall: content grams of a matched section that are still there (1.0 if it had none).

    A section that is the same in both versions keeps all of its grams; those of others are counted inside their row.
    """
    rows = _versions(_chinese(pairs)).where("before_title is not null and after_title is not null")
    x, y = (grams(F.col(f"{c}_body"), F.col("language")) for c in ("before", "after"))
    rows = rows.select("doc_id", "key", x.alias("x"), F.when(F.col("before_body") != F.col("after_body"), y).alias("y"))
    total = F.size("x").cast("long")
    out = rows.select("doc_id", "key", F.when(F.col("y").isNull(), total).otherwise(_kept(F.col("x"), F.col("y"))).alias("retained"), total.alias("total"))
    return out.withColumn("recall", F.when(F.col("total") > 0, F.col("retained") / F.col("total")).otherwise(1.0))


def abstract_conclusion(pairs: DataFrame) -> DataFrame:
    """doc_id, dot, abstract_square, conclusion_square, cosine, for documents whose revision has both sections."""
    rows = segment.sections(with_language(pairs), "after", ("language",))
    named = F.lower("title").rlike("|".join(rf"\Q{h}\E" for h in P.CONCLUSION))
    rows = rows.groupBy("doc_id", "language").agg(F.min_by(F.when(F.col("key") == "abstract", F.col("body")), F.when(F.col("key") == "abstract", F.col("pos"))).alias("x"), F.max_by(F.when(named, F.col("body")), F.when(named, F.col("pos"))).alias("y"))
    rows = rows.where("x is not null and y is not null")
    sums = _counted(rows, ["doc_id"]).groupBy("doc_id").agg(F.sum(F.col("nb") * F.col("na")).alias("dot"), F.sum(F.col("nb") * F.col("nb")).alias("abstract_square"), F.sum(F.col("na") * F.col("na")).alias("conclusion_square"))
    out = rows.select("doc_id").join(sums, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dot", "abstract_square", "conclusion_square")))
    norm = F.sqrt(F.col("abstract_square").cast("double")) * F.sqrt(F.col("conclusion_square").cast("double"))
    return out.withColumn("cosine", F.when(norm > 0, F.col("dot") / norm).otherwise(0.0))


def architecture(pairs: DataFrame) -> DataFrame:
    """doc_id and the lengths of the revision's body sections: n, sum, squares, min, max, cv (sample deviation; 0 for one)."""
    rows = segment.body_sections(segment.sections(with_language(pairs), "after", ("language",)))
    rows = rows.select("doc_id", T.units(F.col("body"), F.col("language")).alias("u"))
    out = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("u").alias("sum"), F.sum(F.col("u") * F.col("u")).alias("squares"), F.min("u").alias("min"), F.max("u").alias("max"))
    return out.withColumn("cv", sample_cv(F.col("n"), F.col("sum"), F.col("squares")))


def sample_cv(n: Column, total: Column, squares: Column) -> Column:
    """Sample deviation over mean, from exact sums; null without values or with mean 0."""
    spread = F.sqrt((n * squares - total * total).cast("double") / (n * (n - 1)))
    return F.when(total > 0, F.when(n > 1, spread / (total / n)).otherwise(0.0))


def labels(sentence: Column, lang: Column, moves: dict = P.MOVES) -> dict[str, Column]:
    return {k: F.when(lang == "zh", sentence.rlike(f"(?iU){moves['zh'][k]}")).otherwise(sentence.rlike(f"(?iU){moves['en'][k]}")) for k in ("claim", "boundary", "recommendation")}


def move_profiles(pairs: DataFrame) -> DataFrame:
    """doc_id, pos, section, sentences, labelled, claim, boundary, recommendation, either (boundary or recommendation), profile."""
    rows = segment.body_sections(segment.sections(with_language(pairs), "after", ("move_language",)))
    rows = rows.select("doc_id", "pos", "title", "move_language", F.posexplode_outer(T.all_sentences(T.clean(F.col("body"), ".md"))).alias("at", "s"))
    marks = labels(F.col("s"), F.col("move_language"))
    rows = rows.select("doc_id", "pos", "title", "at", *(F.coalesce(m, F.lit(False)).alias(k) for k, m in marks.items()))
    count = lambda c: F.sum(c.cast("long"))
    c, b, r = (F.col(k) for k in marks)
    out = rows.groupBy("doc_id", "pos").agg(
        F.first("title").alias("section"), F.count("at").alias("sentences"), count(c | b | r).alias("labelled"), count(c).alias("claim"), count(b).alias("boundary"), count(r).alias("recommendation"), count(b | r).alias("either"),
        *(F.min(F.when(F.col(k), F.col("at"))).alias(f"first_{k}") for k in marks),
    )
    order = F.array_sort(F.filter(F.array(*(F.when(F.col(f"first_{k}").isNotNull(), F.struct(F.col(f"first_{k}").alias("at"), F.lit(i).alias("rank"), F.lit(k[0].upper()).alias("l"))) for i, k in enumerate(marks))), lambda x: x.isNotNull()))
    profile = F.when(F.size(order) > 0, F.array_join(F.transform(order, lambda x: x["l"]), "-")).otherwise("none")
    return out.select("doc_id", "pos", "section", "sentences", "labelled", "claim", "boundary", "recommendation", "either", profile.alias("profile"))


def profile_modes(pairs: DataFrame) -> DataFrame:
    """doc_id, sections, common_profile (ties: first seen), common_count, claim_boundary, all_three, sentences, either."""
    rows = move_profiles(pairs)
    of = rows.groupBy("doc_id", "profile").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    common = of.groupBy("doc_id").agg(F.max_by(F.struct("profile", "n"), F.struct("n", -F.col("first"))).alias("x"))
    flag = lambda c: F.sum(c.cast("long"))
    c, b, r = (F.col(k) > 0 for k in ("claim", "boundary", "recommendation"))
    sums = rows.groupBy("doc_id").agg(F.count("*").alias("sections"), flag(c & b).alias("claim_boundary"), flag(c & b & r).alias("all_three"), F.sum("sentences").alias("sentences"), F.sum("either").alias("either"))
    return sums.join(common, "doc_id").select("doc_id", "sections", F.col("x.profile").alias("common_profile"), F.col("x.n").alias("common_count"), "claim_boundary", "all_three", "sentences", "either")


def residue(pairs: DataFrame) -> DataFrame:
    """doc_id, label, n: editorial-process language in the revision."""
    found = F.array(*(F.struct(F.lit(label).alias("label"), T.count_all(F.coalesce("after", F.lit("")), f"(?iU){p}").alias("n")) for label, p in P.RESIDUE))
    return pairs.select("doc_id", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.label", "x.n")


def placeholders(pairs: DataFrame) -> DataFrame:
    """doc_id, placeholder, n."""
    after = F.coalesce("after", F.lit(""))
    rows = pairs.select("doc_id", F.explode(F.concat(*(T.find_all(after, f"(?iU){p}") for p in P.PLACEHOLDERS))).alias("p"))
    return rows.withColumn("placeholder", T.squeeze(T.nfkc("p"))).groupBy("doc_id", "placeholder").agg(F.count("*").alias("n"))


def _matched(low: float) -> Column:
    """struct(low, missing, added) from the columns before and after, each array<struct<key, pos, units>>: a section is its key's last."""
    entry = lambda side: lambda x: F.struct(x["key"].alias("key"), F.lit(side).alias("side"), x["pos"].alias("pos"), x["units"].alias("units"))
    entries = F.array_sort(F.concat(F.transform("before", entry(0)), F.transform("after", entry(1))))
    return T.let(entries, lambda every: F.aggregate(F.filter(every, lambda x, i: ~_same(x, F.get(every, i + 1))), F.expr("named_struct('key', '', 'units', -1L, 'low', 0L, 'missing', 0L, 'added', 0L)"), _match(low), lambda a: F.struct(a["low"].alias("low"), a["missing"].alias("missing"), a["added"].alias("added"))))


def _same(x: Column, y: Column) -> Column:
    return F.coalesce((x["key"] == y["key"]) & (x["side"] == y["side"]), F.lit(False))


def _match(low: float) -> Callable[[Column, Column], Column]:
    """One step over sections in order of key, the earlier version's first; units is -1 unless a section waits for its match."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def step(a: Column, x: Column) -> Column:
        old = x["side"] == 0
        met = ~old & (a["key"] == x["key"]) & (a["units"] >= 0)
        judged = met & ~x["key"].isin("abstract", "references") & (a["units"] > 0) & (F.round(x["units"] / a["units"], 4) < low)
        return F.struct(
            x["key"].alias("key"),
            F.when(old, x["units"]).otherwise(F.lit(-1).cast("long")).alias("units"),
            (a["low"] + F.when(judged, one).otherwise(none)).alias("low"),
            (a["missing"] + F.when(old, one).when(met, -one).otherwise(none)).alias("missing"),
            (a["added"] + F.when(~old & ~met, one).otherwise(none)).alias("added"),
        )

    return step


def _moves(sentences: Column, lang: Column) -> Column:
    """struct(profile, sentences, either, claim, boundary) of a section's sentences."""
    kinds = ("claim", "boundary", "recommendation")
    marks = F.transform(sentences, lambda s: F.struct(*(m.alias(k) for k, m in labels(s, lang).items())))

    def judged(m: Column) -> Column:
        first = lambda k: F.array_position(F.transform(m, lambda x: F.coalesce(x[k], F.lit(False))), F.lit(True))
        places = F.array(*(F.struct(first(k).alias("at"), F.lit(i).alias("rank"), F.lit(k[0].upper()).alias("l")) for i, k in enumerate(kinds)))
        order = F.array_join(F.transform(F.array_sort(F.filter(places, lambda x: x["at"] > 0)), lambda x: x["l"]), "-")
        count = lambda f: F.size(F.filter(m, f)).cast("long")
        return F.struct(
            F.when(order != "", order).otherwise("none").alias("profile"),
            F.size(m).cast("long").alias("sentences"),
            count(lambda x: x["boundary"] | x["recommendation"]).alias("either"),
            (count(lambda x: x["claim"]) > 0).alias("claim"),
            (count(lambda x: x["boundary"]) > 0).alias("boundary"),
        )

    return T.let(marks, judged)


def _cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays of grams as multisets; 0 if one is empty.  One pass over both, sorted."""
    placed = lambda g, side: F.transform(g, lambda v: F.struct(v.alias("g"), F.lit(side).alias("side")))
    start = F.expr("named_struct('g', cast(null as string), 'a', 0L, 'b', 0L, 'dot', 0L, 'aa', 0L, 'bb', 0L)")

    def step(s: Column, v: Column) -> Column:
        same = F.coalesce(s["g"] == v["g"], F.lit(False))
        left = v["side"] == 0
        a, b = (F.when(same, s[c]).otherwise(F.lit(0).cast("long")) for c in "ab")
        # sums of products and squares grow by what one more of a kind adds
        return F.struct(
            v["g"].alias("g"),
            F.when(left, a + 1).otherwise(a).alias("a"),
            F.when(left, b).otherwise(b + 1).alias("b"),
            (s["dot"] + F.when(left, b).otherwise(a)).alias("dot"),
            (s["aa"] + F.when(left, 2 * a + 1).otherwise(0)).alias("aa"),
            (s["bb"] + F.when(left, 0).otherwise(2 * b + 1)).alias("bb"),
        )

    def finish(s: Column) -> Column:
        norm = F.sqrt(s["aa"].cast("double")) * F.sqrt(s["bb"].cast("double"))
        return F.when(norm > 0, s["dot"] / norm).otherwise(0.0)

    return F.aggregate(F.array_sort(F.concat(placed(x, 0), placed(y, 1))), start, step, finish)


def document_findings(pairs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each document with all that the findings judge, from one parse of both versions: nothing is shuffled."""
    lang, moves = F.col("language"), F.col("move_language")
    total = lambda text, patterns: sum((T.count_all(text, f"(?iU){p}") for p in patterns), F.lit(0).cast("long"))
    rows = with_language(pairs).select(
        "doc_id", "language", "move_language", T.units(F.col("b"), lang).alias("before_units"), T.units(F.col("a"), lang).alias("after_units"),
        total(F.coalesce("after", F.lit("")), (p for _, p in P.RESIDUE)).alias("residue"), total(F.coalesce("after", F.lit("")), P.PLACEHOLDERS).alias("placeholders"),
        *(segment.keyed_array(F.col(c)).alias(c) for c in ("before", "after")),
    )
    rows = rows.withColumns({c: F.transform(c, lambda s, i: F.struct(s["key"].alias("key"), i.alias("pos"), s["level"].alias("level"), s["title"].alias("title"), s["body"].alias("body"), T.units(s["body"], lang).alias("units"))) for c in ("before", "after")})
    plain = lambda array: F.filter(array, lambda s: ~((s["level"] == 1) & (F.size(array) > 1)))
    named = lambda s: F.lower(s["title"]).rlike("|".join(rf"\Q{h}\E" for h in P.CONCLUSION))
    after = F.col("after")
    rows = rows.select(
        "doc_id", "language", "move_language", "before_units", "after_units", "residue", "placeholders",
        *(plain(F.col(c)).alias(c) for c in ("before", "after")),
        F.get(F.filter(after, lambda s: s["key"] == "abstract"), F.lit(0))["body"].alias("abstract"),
        F.try_element_at(F.filter(after, named), F.lit(-1))["body"].alias("conclusion"),
    )
    body = F.filter(after, lambda s: ~s["key"].isin("abstract", "references"))
    rows = rows.select(
        "doc_id", "before_units", "after_units", "residue", "placeholders",
        _matched(limits.min_section_retention).alias("matched"),
        F.transform(body, lambda s: s["units"]).alias("lengths"),
        F.transform(body, lambda s: _moves(T.all_sentences(T.clean(s["body"], ".md")), moves)).alias("moves"),
        F.when(F.col("abstract").isNotNull() & F.col("conclusion").isNotNull(), _cosine(grams(F.col("abstract"), lang), grams(F.col("conclusion"), lang))).alias("cosine"),
    )
    sums = F.aggregate("lengths", F.expr("named_struct('s', 0L, 'q', 0L)"), lambda a, u: F.struct((a["s"] + u).alias("s"), (a["q"] + u * u).alias("q")))
    long = lambda c: c.cast("long")
    of = lambda f: long(F.size(F.filter("moves", f)))
    over = lambda k: F.aggregate("moves", long(F.lit(0)), lambda a, m: a + m[k])
    rows = rows.select(
        "doc_id", "before_units", "after_units", "residue", "placeholders", "matched.*", "cosine",
        long(F.size("lengths")).alias("body"), sums.alias("sums"), long(F.size("moves")).alias("sections"),
        T.mode(F.transform("moves", lambda m: m["profile"]), "string").alias("common"),
        of(lambda m: m["claim"] & m["boundary"]).alias("claim_boundary"), over("sentences").alias("sentences"), over("either").alias("either"),
    )
    cv = F.round(sample_cv(F.col("body"), F.col("sums.s"), F.col("sums.q")), 3)
    return rows.select("*", cv.alias("cv"), F.col("common.v").alias("common_profile"), F.col("common.n").alias("common_count")).withColumn("cosine", F.round("cosine", 4))


def findings(pairs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, failures, warnings (codes in order, comma-joined), status.

    Sections below the floor and the architecture's cv are judged after rounding
    to four and three places, the overall retention before.
    """
    rows = document_findings(pairs, limits)
    n = lambda c: F.coalesce(c, F.lit(0))
    retention = F.when(F.col("before_units") > 0, F.col("after_units") / F.col("before_units")).otherwise(1.0)
    ready, sections, cv = F.lit(limits.publication_ready), n("sections"), F.col("cv")
    share = lambda a, b: F.when(n(b) > 0, n(a) / F.col(b)).otherwise(0.0)
    failures = [
        (F.lit(limits.min_output_units is not None) & (F.col("after_units") < (limits.min_output_units or 0)), "G01_MIN_OUTPUT_UNITS"),
        (retention < limits.min_overall_retention, "G02_OVERALL_RETENTION"),
        (n("low") > limits.max_low_retention_sections, "G03_SECTION_RETENTION"),
        (n("missing") > 0, "G04_MISSING_HEADINGS"),
        (ready & (n("residue") > 0), "G05_EDITORIAL_RESIDUE"),
        (ready & (n("placeholders") > 0), "G06_SOURCE_PLACEHOLDERS"),
    ]
    warnings = [
        (~ready & (n("residue") > 0), "W01_EDITORIAL_RESIDUE"),
        (~(ready & (n("placeholders") > 0)) & (n("placeholders") >= 5), "W02_REPEATED_SOURCE_PLACEHOLDER"),
        ((n("body") >= 8) & (cv < 0.22), "W03_HOMOGENISED_SECTION_ARCHITECTURE"),
        ((sections >= 8) & (((share("common_count", "sections") >= 0.50) & (F.col("common_profile") != "none")) | ((share("claim_boundary", "sections") >= 0.75) & (cv < 0.25))), "W04_REPEATED_RHETORICAL_PROFILE"),
        ((n("sentences") >= 40) & (share("either", "sentences") >= 0.35), "W05_BOUNDARY_RECOMMENDATION_SATURATION"),
        (F.col("cosine") >= 0.50, "W06_ABSTRACT_CONCLUSION_OVERLAP"),
        (n("added") > 0, "W07_ADDED_HEADINGS"),
    ]
    listed = lambda rules: F.array_join(F.filter(F.array(*(F.when(c, code) for c, code in rules)), lambda x: x.isNotNull()), ",")
    out = rows.select("doc_id", listed(failures).alias("failures"), listed(warnings).alias("warnings"))
    return out.withColumn("status", F.when(F.col("failures") != "", "fail").when(F.col("warnings") != "", "review").otherwise("pass"))
