"""Each stage against a plain version over what its predecessor kept."""

import shutil
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import test_line_dedup
import test_ngram_join
import test_packing

import __spark_entry__
import corpus_pipeline
from vellum.llm.decontaminate import contaminated
from vellum.llm.queries import queries
from vellum.llm.toxicity import toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    """sf0.001 with some odd rows: nulls, repeats, an unknown column."""
    out = tmp_path_factory.mktemp("small")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.limit(1).first()
    odd = spark.createDataFrame([(None, "only words here now ok", None, None, 22), (9001, None, "en", None, None), (9002, "", None, "src1", 0), (some.doc_id, some.text, some.lang, some.source, some.n_chars), (None, "only words here now ok", "en", "x", 22)], docs.schema)
    docs.union(odd).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{sf_dir}/{t}.parquet", f"{out}/{t}.parquet")
    return str(out)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    rows = lambda df: sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)

    scored = toxicity_scores(docs, spark.read.parquet(f"{small}/labels.parquet"), tuple(COLUMNS))
    kept = steps["toxicity"](spark, docs, small)
    assert kept.columns == COLUMNS
    assert rows(kept) == rows(scored.where("predicted = 0"))

    before = kept.collect()
    lines = steps["line_dedup"](spark, spark.createDataFrame(before, docs.schema), small)
    order = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    distinct = list(dict.fromkeys((r.doc_id, r.text) for r in order))
    plain = {(k, t): (u, gone) for (k, t), (_, u, gone) in zip(distinct, test_line_dedup.brute(distinct))}
    want = []
    for r in before:
        text, gone = plain[r.doc_id, r.text]
        if not gone or text.strip():
            want.append((r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars))
    assert rows(lines) == sorted(want, key=str)

    joined = steps["ngram_join"](spark, spark.createDataFrame(want, docs.schema), small)
    ids = [(r[0] if r[0] is not None else f"none {r[1]}", r[1]) for r in want]
    number = {k: n for n, k in enumerate(dict.fromkeys(k for k, _ in ids))}
    numbered = [(k if isinstance(k, int) else -1000 + number[k], t) for k, t in ids]
    gone = {k for k, _, c in test_ngram_join.brute(numbered) if k != c}
    left = {(numbered[i][0], want[i][1]): want[i] for i in range(len(want)) if numbered[i][0] not in gone}
    assert sorted((r[:2] for r in rows(joined)), key=str) == sorted((w[:2] for w in left.values()), key=str)

    rest = joined.collect()
    hit = {r.doc_id for r in contaminated(spark.createDataFrame(rest, docs.schema), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    clean = steps["decontamination"](spark, spark.createDataFrame(rest, docs.schema), small)
    assert hit and rows(clean) == sorted((tuple(r) for r in rest if r.doc_id not in hit), key=str)

    packed = steps["packing"](spark, spark.createDataFrame(clean.collect(), docs.schema), small)
    assert packed.select("doc_id").distinct().count() == len({r.doc_id for r in clean.collect()})
    test_packing.check(spark, [(r.doc_id, r.text) for r in clean.collect()])


def test_run_and_empty(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 0
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{small}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = [*queries(), "pipeline"]
    assert set(names) <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def test_clashing_columns(spark, small):
    """Columns named as those that stages make are carried along."""
    names = ("score", "predicted", "held_out", "key", "removed_lines", "__key", "doc id")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    docs = docs.selectExpr("*", *(f"{i} as `{n}`" for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}, name
