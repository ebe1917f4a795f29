"""Facts about single operators, restated as rows."""

import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import gate, guard, lock, segment, style, texture
from vellum.operators.lock import protected_of


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("", "mixed"), ("abc 1", "mixed"), ("word " * 10, "en"), ("研究" * 5, "zh"), ("研究" * 6 + " word" * 11, "mixed"), ("研" * 12 + " word" * 10, "zh")],
)
def test_language(spark, text, want):
    assert one(spark, T.language(F.col("t")), t=text) == want


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="It's well-known: 3.14, é, 研究 x2") == ["It's", "well-known", "3.14", "研", "究", "x", "2"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Smith came here. He left soon! Why not? 好的吗？是的。", ["Dr. Smith came here.", "He left soon!", "Why not?", "好的吗？", "是的。"]),
        ("These items. The end comes", ["These iteMs. The end comes"]),
        ("One two. three four. (Five six. Seven", ["One two. three four.", "(Five six."]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences(F.col("t")), t=text) == want


def test_clean(spark):
    md = "# Head\r\n\r\n> quote `code` **x** ![pic](u) [link](v)\n- item\n1. item\n---\n```\ngone\n```\n\n\n\n<b>tag</b>\x07 end "
    assert one(spark, T.clean(F.col("t"), ".md"), t=md) == "Head\nquote code **x** pic link\nitem\nitem\n\ntag end"
    tex = "A % note\n\\section{One} $x$ \\cite{a} $$y$$ \\begin{equation}z\\end{equation} \\emph{b}~c \\$5"
    assert "One" in one(spark, T.clean(F.col("t"), ".tex"), t=tex).split("\n")
    assert len(one(spark, T.clean_latex(F.col("t")), t="$" + "a" * 100000 + "$ b \\$ " + "\\$" * 20000)) > 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("dose 5 mg, p < 0.05 and 1,234.5 kg/m2", ["5 mg", "p < 0.05", "1,234.5 kg/m2"]),
        ("x5 5x 1.2.3 −3e−4 .5%", ["1.2", "−3e−4", ".5%"]),
        ("1.0 1.00 １２％ 3 groups", ["1.0", "1.00", "12%", "3"]),
    ],
)
def test_lock_numbers(spark, text, want):
    assert one(spark, T.find_all(T.nfkc(F.col("t")), lock.NUMBERS), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see https://doi.org/10.1234/ab(c)). And (http://x.y/z),", ["10.1234/ab(c)", "https://doi.org/10.1234/ab(c)", "http://x.y/z"]),
        ("10.12/short x10.1234/no", []),
    ],
)
def test_identifiers(spark, text, want):
    assert one(spark, lock.identifiers(F.col("t")), t=text) == want


def test_stance(spark):
    s = {k: one(spark, v, t="We cannot, can't and can. Not due to it; results in harm. Émay may 不能 可能") for k, v in lock.stance(F.col("t")).items()}
    assert sorted(s["stance_negation"]) == sorted(["cannot", "can't", "not", "不能"])
    assert sorted(s["stance_modality"]) == sorted(["can", "may", "可能"])
    assert s["stance_causal"] == ["due to", "results in"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"\cite[p. 3]{a, b} \parencites{c}{d} \parencite{e}{f}", ["a", "b", "c", "d", "e"]),
        ("Smith et al. (2019) and (van der Meer, 2020; Lee & Kim, 2021b) [1, 3-5] [x]", ["Smith et al. (2019)", "(van der Meer, 2020; Lee & Kim, 2021b)", "[1, 3-5]"]),
        (r"\cite[12]{a} \cite[see \citep{b}]{c} [12] \cite[Smith (2019)]{d} \citeX \cite {e}", ["a", "c", "b", "d", "e", "[12]"]),
        ("", []),
    ],
)
def test_citations(spark, text, want):
    assert one(spark, lock.citations(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a `b` ``c ` d`` $e$ \\$f\\$ $$g $ h$$", ["`b`", "``c ` d``", "$e$", "$$g $ h$$"]),
        ("````\n```\nx\n`````\nend `y`", ["````\n```\nx\n`````", "`y`"]),
        (r"\begin{align*}a $b$\end{align*} \[c\] \(d\)", [r"\begin{align*}a $b$\end{align*}", r"\[c\]", r"\(d\)"]),
        ("```\nnever closed `z`", ["`z`"]),
        ("~~~~\n```\n~~~\n~~~~.\n$x$\n~~~\na\n~~~", ["~~~~\n```\n~~~\n~~~~", "$x$", "~~~\na\n~~~"]),
    ],
)
def test_protected(text, want):
    assert protected_of(text) == want


def test_protected_leaves_plain_texts_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "plain"), (2, "a `b`"), (3, "")], "id int, t string")
    assert [r.x for r in df.select("id", lock.protected_spans(F.col("t")).alias("x")).orderBy("id").collect()] == [[], ["`b`"], []]


def pairs(spark, *rows):
    return spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(rows)], "doc_id long, before string, after string")


def test_differences_keep_multiplicity(spark):
    df = pairs(spark, ("5 mg 5 mg 7", "5 mg 9"), ("same 1", "same 1"), (None, "3"))
    out = {(r.doc_id, r.value): (r.removed, r.added) for r in lock.lock_category(df, ("numbers",)).collect()}
    assert out == {(0, "5 mg"): (1, 0), (0, "7"): (1, 0), (0, "9"): (0, 1), (1, "1"): (0, 0), (2, "3"): (0, 1)}


def test_status(spark):
    df = pairs(spark, ("a 5", "a 6"), ("it may", "it must"), ("a", "b"), ("alpha", "beta"))
    assert {r.doc_id: r.status for r in lock.lock_status(df, ["alpha"]).collect()} == {0: "fail", 1: "review", 2: "pass", 3: "fail"}


def test_guard(spark):
    df = pairs(spark, ("# A\n\nWord 3 groups [1].", "# B\n\nWord 4 groups [1]."), ("x", "x"), ("", "new text"), ("long text here", "l"))
    out = {r.doc_id: (r.blockers, r.status) for r in guard.blockers(df).collect()}
    assert out[0] == ("numbers removed or changed; numbers added or changed; Markdown heading text/order changed", "FAIL")
    assert out[1] == out[2] == ("", "PASS")
    assert out[3] == ("length retention below 0.55", "FAIL")


def test_overlap(spark):
    df = pairs(spark, ("a b c d e f", "a b c d e g"), ("", ""), ("研究结果表明效果", "研究结果表明效用"))
    out = {r.doc_id: r for r in guard.overlap(df).collect()}
    assert (out[0].shared_ngrams, out[0].jaccard) == (1, 1 / 3)
    assert out[1].jaccard == out[1].original_recall == 1.0
    assert out[2]["mode"] == "6-character" and out[2].shared_ngrams == 2


def test_sections(spark):
    text = "preface\n# T\nintro\n## 1.2 One\nbody\n\n## 1) Two\n\n## Abstract\nx\n##   References \nr"
    df = spark.createDataFrame([(1, text), (2, "no heading"), (3, "")], "doc_id long, t string")
    rows = [(r.doc_id, r.level, r.title, r.key, r.body) for r in segment.sections(df, "t").orderBy("doc_id", "pos").collect()]
    assert rows == [
        (1, 1, "T", "t:t", "intro"), (1, 2, "1.2 One", "n:1", "body"), (1, 2, "1) Two", "n:1", ""), (1, 2, "Abstract", "abstract", "x"), (1, 2, "References", "references", "r"),
        (2, 1, "Document", "document", "no heading"), (3, 1, "Document", "document", ""),
    ]
    assert [r.title for r in segment.body_sections(segment.sections(df.where("doc_id = 1"), "t")).collect()] == ["1.2 One", "1) Two"]


def manuscript(n=10, body="The study shows it. It cannot be known. We should test it. Therefore the conclusion holds."):
    return "# T\n\n" + "\n\n".join(f"## {k}. Part {k}\n\n{body}\n\n{body}" for k in range(1, n + 1))


def test_gate(spark):
    full = manuscript()
    df = pairs(spark, (full, full), (full, manuscript(9)), (full, full.replace("should test", "source required [SOURCE REQUIRED] test")), ("a " * 50, "a"))
    out = {r.doc_id: r for r in gate.findings(df).collect()}
    assert out[0].failures == "" and "W03" in out[0].warnings and "W04" in out[0].warnings and "W05" in out[0].warnings
    assert out[1].failures == "G04_MISSING_HEADINGS"
    assert "W01" in out[2].warnings and "W02" in out[2].warnings
    assert out[3].status == "fail" and "G02_OVERALL_RETENTION" in out[3].failures
    strict = {r.doc_id: r for r in gate.findings(df, gate.Limits(min_output_units=10**6, publication_ready=True)).collect()}
    assert strict[2].failures.split(",") == ["G01_MIN_OUTPUT_UNITS", "G05_EDITORIAL_RESIDUE", "G06_SOURCE_PLACEHOLDERS"]
    recall = gate.content_recall(df).agg(F.min("recall"), F.max("recall")).first()
    assert 0 <= recall[0] <= recall[1] <= 1


def test_content_recall(spark):
    """Multisets of grams, the last section of a key, Chinese pairs; both versions parsed once and shuffled once."""
    zh = "深度学习模型方法有效证据" * 2
    before = "# T\n\n## 1. A\n\nold old text\n\n## 1. B\n\nalpha alpha alpha beta\n\n## 2. C\n\nsame words here\n\n## 3. D\n\nis it\n\n## 4. E\n\ngone"
    after = "# T\n\n## 1. B\n\nalpha beta alpha alpha alpha\n\n## 2. C\n\nsame words here\n\n## 3. D\n\nno\n\n## 5. F\n\nnew"
    df = pairs(spark, (before, after), (f"## 1. X\n\n{zh}", f"## 1. X\n\n{zh[:12]}"), (None, None), ("## 1. X\n\n`" + zh + "` " + "plain words " * 20, "## 1. X\n\nplain words"))
    out = gate.content_recall(df)
    rows = {(r.doc_id, r.key): (r.retained, r.total) for r in out.collect()}
    # 1. B: alpha three times, beta, alpha alpha twice, alpha beta
    assert {k: v for k, v in rows.items() if k[0] == 0} == {(0, "n:1"): (7, 7), (0, "n:2"): (5, 5), (0, "n:3"): (0, 0)}
    assert rows[1, "n:1"] == (21, 45) and rows[2, "document"] == (0, 0) and rows[3, "n:1"] == (3, 79)
    assert {r.recall for r in out.where("total = 0").collect()} == {1.0}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("max_by(") and plan.count("Join") == 0 and plan.count("Generate explode") == 1 and len(re.findall(r"Scan|LocalTableScan", plan)) == 1


def test_texture(spark):
    plain = "# T\n\n" + "\n\n".join(f"## {k}. P\n\n" + "\n\n".join("Words go on here." for _ in range(k)) for k in range(1, 10))
    df = spark.createDataFrame([(1, manuscript()), (2, plain), (3, ""), (4, "# 5 Only heading")], "doc_id long, t string")
    out = {r.doc_id: r for r in texture.signals(df, "t", strict=True).collect()}
    assert out[1].status == "fail" and {"T01", "T06", "T07"} <= {w[:3] for w in out[1].warnings.split(",")} and "G02" in out[1].failures
    assert out[2].warnings.split(",") == ["T02_PARAGRAPH_LENGTH_HOMOGENEITY", "T03_SENTENCE_COUNT_PER_PARAGRAPH_HOMOGENEITY"]
    assert out[2].status == "review" and out[3].status == out[4].status == "pass"


@pytest.mark.parametrize(("cv", "n", "want"), [(0.1, 3, "insufficient_data"), (0.1799, 4, "very_low_variation"), (0.18, 4, "low_variation"), (0.32, 9, "moderate_variation"), (0.5, 9, "high_variation"), (None, 9, "insufficient_data")])
def test_variation(spark, cv, n, want):
    df = spark.createDataFrame([(cv, n)], "cv double, n long")
    assert df.select(T.variation(F.col("cv"), F.col("n")).alias("x")).first().x == want


def test_cjk_phrases(spark):
    text = "深度学习方法。" * 3 + "研究深度学习" * 3
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [(r.phrase, r.n) for r in style.cjk_phrases(df).orderBy("rank").collect()]
    assert rows[0] == ("深度学习", 6) and ("研究深度学习", 3) in rows and len(rows) <= style.MAX_ITEMS


def test_null_and_empty_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for operator in (style.token_table, style.units_and_language, style.sentence_table, style.describe, style.lexical, style.punctuation):
        assert operator(df).count() == 2
    for operator in (style.openings, style.trigrams, style.stock_phrases, style.term_counts, style.triads, style.cjk_phrases):
        assert operator(df).count() == 0
