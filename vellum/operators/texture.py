"""The rhetorical texture audit: per-section geometry and density, document roll-up, T01 to T08 and the strict combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import text as T
from vellum.operators.gate import labels, sample_cv
from vellum.operators.segment import texture_sections


def _hits(text: Column, zh: Column, table: dict[str, str]) -> Column:
    return F.when(zh, text.rlike(f"(?iU){table['zh']}")).otherwise(text.rlike(f"(?iU){table['en']}"))


def _meta_array(text: Column, zh: Column) -> Column:
    of = lambda lang: F.filter(F.array(*(F.struct(F.lit(label).alias("label"), T.count_all(text, f"(?iU){p}").alias("n")) for label, p in P.META[lang])), lambda x: x["n"] > 0)
    return F.when(zh, of("zh")).otherwise(of("en"))


def _total(meta: Column) -> Column:
    return F.aggregate(meta, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def section_rows(docs: DataFrame, column: str, suffix: str = ".md") -> DataFrame:
    """A row for each body section with everything that is counted in it; documents without one have a row without a title."""
    rows = texture_sections(docs, column, suffix)
    zh = F.col("language") == "zh"
    rows = rows.select("doc_id", "language", "n_sections", "pos", "title", "body", T.paragraphs(T.clean(F.col("body"), ".md")).alias("p"))
    rows = rows.withColumn("split", F.transform("p", T.sentences)).withColumn("s", F.flatten("split")).withColumn("last", F.coalesce(F.try_element_at("p", F.lit(-1)), F.lit(""))).withColumn("final", F.coalesce(F.try_element_at("split", F.lit(-1)), F.array().cast("array<string>")))
    marks = F.transform("s", lambda s: F.struct(*(m.alias(k) for k, m in labels(s, F.col("language"), P.TEXTURE_MOVES).items()), _hits(s, zh, P.CORRECTIVE).alias("corrective")))
    rows = rows.withColumn("marks", marks)
    count = lambda k: F.size(F.filter("marks", lambda m: m[k])).cast("long")
    ends = F.exists("final", lambda s: labels(s, F.col("language"), P.TEXTURE_MOVES)["boundary"] | labels(s, F.col("language"), P.TEXTURE_MOVES)["recommendation"])
    return rows.select(
        "doc_id", "language", "n_sections", "pos", "title",
        F.size("p").cast("long").alias("paragraphs"),
        F.transform("p", lambda p: T.units(p, F.col("language"))).alias("paragraph_units"),
        F.transform("split", lambda s: F.size(s).cast("long")).alias("sentence_counts"),
        F.size("s").cast("long").alias("sentences"),
        *(count(k).alias(k) for k in ("claim", "boundary", "recommendation", "corrective")),
        _total(_meta_array(F.col("body"), zh)).alias("meta"),
        ((F.col("last") != "") & _hits(F.col("last"), zh, P.CORRECTIVE)).alias("closure_corrective"),
        ((F.col("last") != "") & (_hits(F.col("last"), zh, P.CLOSURE) | (_total(_meta_array(F.col("last"), zh)) > 0))).alias("closure_judgement"),
        ends.alias("closure_boundary"),
    )


def corrective(docs: DataFrame, column: str) -> DataFrame:
    return section_rows(docs, column).where("pos is not null").select("doc_id", "pos", "title", "sentences", "corrective")


def closures(docs: DataFrame, column: str) -> DataFrame:
    return section_rows(docs, column).where("pos is not null").select("doc_id", "pos", "closure_corrective", "closure_judgement", "closure_boundary")


def meta_voice(docs: DataFrame, column: str) -> DataFrame:
    """doc_id, pos, label, n in each body section."""
    rows = texture_sections(docs, column).where("pos is not null")
    return rows.select("doc_id", "pos", F.explode(_meta_array(F.col("body"), F.col("language") == "zh")).alias("x")).select("doc_id", "pos", "x.label", "x.n")


def _described(values: Column, name: str) -> list[Column]:
    """n, sum, squares, min, max, mode (ties: first seen) and its count, from an array in order."""
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x * x)
    best = T.mode(values, "long")
    return [
        F.size(values).cast("long").alias(f"{name}_n"), total.alias(f"{name}_sum"), squares.alias(f"{name}_squares"), F.array_min(values).alias(f"{name}_min"), F.array_max(values).alias(f"{name}_max"),
        best["v"].alias(f"{name}_mode"), best["n"].alias(f"{name}_mode_count"),
    ]


GEOMETRY = ("paragraphs_per_section", "paragraph_units", "sentences_per_paragraph")


def rollup(docs: DataFrame, column: str) -> DataFrame:
    """One row per document: geometry and counts over its body sections."""
    rows = section_rows(docs, column)
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    ordered = lambda *c: F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", *c))))
    three = (F.col("claim") > 0) & (F.col("boundary") > 0) & (F.col("recommendation") > 0)
    out = rows.groupBy("doc_id").agg(
        F.first("language").alias("language"),
        F.count("pos").alias("sections"),
        *(F.coalesce(F.sum(F.when(F.col("pos").isNotNull(), F.col(k))), F.lit(0)).alias(k) for k in ("sentences", "boundary", "recommendation", "corrective")),
        flag(three).alias("all_three"), flag(F.col("meta") > 0).alias("meta_sections"),
        *(flag(F.col(k) & F.col("pos").isNotNull()).alias(k) for k in ("closure_corrective", "closure_judgement", "closure_boundary")),
        F.coalesce(F.sum(F.when(F.col("pos").isNotNull(), F.col("meta"))), F.lit(0)).alias("meta"),  # no pattern reaches over a line's end
        ordered("paragraphs", "paragraph_units", "sentence_counts").alias("x"),
    )
    arrays = (F.transform("x", lambda s: s["paragraphs"]), F.flatten(F.transform("x", lambda s: s["paragraph_units"])), F.flatten(F.transform("x", lambda s: s["sentence_counts"])))
    for name, values in zip(GEOMETRY, arrays, strict=True):
        out = out.withColumn(name, values)
    return out.select(*(c for c in out.columns if c not in (*GEOMETRY, "x")), *(d for name in GEOMETRY for d in _described(F.col(name), name)))


def signals(docs: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """doc_id, warnings, failures (codes, comma-joined), status; cv and coverage of a mode are judged after rounding to three and four places."""
    r = rollup(docs, column)
    cv = lambda g: F.round(sample_cv(F.col(f"{g}_n"), F.col(f"{g}_sum"), F.col(f"{g}_squares")), 3)
    coverage = lambda g: F.round(F.col(f"{g}_mode_count") / F.col(f"{g}_n"), 4)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    many = F.col("sections") >= 8
    per, size, sent = GEOMETRY
    rules = [
        (many & (cv(per) < 0.10) & ((coverage(per) >= 0.60) | (F.col(f"{per}_max") - F.col(f"{per}_min") <= 1)), "T01_SECTION_PARAGRAPH_COUNT_HOMOGENEITY", True),
        ((F.col(f"{size}_n") >= 40) & (cv(size) < 0.18), "T02_PARAGRAPH_LENGTH_HOMOGENEITY", False),
        ((F.col(f"{sent}_n") >= 40) & (cv(sent) < 0.20) & (coverage(sent) >= 0.45), "T03_SENTENCE_COUNT_PER_PARAGRAPH_HOMOGENEITY", False),
        ((F.col("sentences") >= 80) & (share("corrective", "sentences") >= 0.22), "T04_CORRECTIVE_NEGATION_SATURATION", True),
        ((F.col("meta") >= 4) | (share("meta_sections", "sections") >= 0.25), "T05_META_ADJUDICATION_VOICE", True),
        (many & (share("closure_judgement", "sections") >= 0.75), "T06_UNIFORM_ADJUDICATIVE_SECTION_ENDINGS", True),
        (many & (share("all_three", "sections") >= 0.75), "T07_ALL_SECTIONS_USE_CLAIM_BOUNDARY_RECOMMENDATION_SET", True),
        (many & (share("closure_boundary", "sections") >= 0.80), "T08_BOUNDARY_OR_RECOMMENDATION_CLOSURE_SATURATION", True),
    ]
    listed = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    strong = listed([F.when(c, code) for c, code, s in rules if s])
    rows = r.select("doc_id", listed([F.when(c, code) for c, code, _ in rules]).alias("w"), strong.alias("strong"), share("all_three", "sections").alias("three"))
    lockstep = F.array_contains("strong", rules[0][1]) & F.array_contains("strong", rules[5][1]) & (F.col("three") >= 0.90)
    failures = listed([F.when(F.lit(strict) & (F.size("strong") >= 3), "G01_COMBINED_TEMPLATE_SATURATION"), F.when(F.lit(strict) & lockstep, "G02_SECTION_GEOMETRY_AND_MOVE_SET_LOCKSTEP")])
    out = rows.select("doc_id", F.array_join("w", ",").alias("warnings"), F.array_join(failures, ",").alias("failures"))
    return out.withColumn("status", F.when(F.col("failures") != "", "fail").when(F.col("warnings") != "", "review").otherwise("pass"))
