"""From raw documents to packed training sequences: five stages over one corpus.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last returns packed pieces.  Stages are written as Parquet
and read again.  Rows without a doc_id are told apart by their text.  Columns
other than doc_id and text are carried along whatever their names; n_chars
follows the text where lines are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.decontaminate import contaminated
from vellum.llm.line_dedup import dedup_lines
from vellum.llm.ngram_join import ngram_components
from vellum.llm.packing import pack_documents
from vellum.llm.queries import word_tokenizer
from vellum.llm.toxicity import toxicity_scores
from vellum.llm.workspace import fresh_path, materialize, sized

#: Ids that are broadcast at most; more are joined by shuffling.
IDS = 200_000

#: No SQL can express the classifier, the alignment and the packing.
ORACLE_SQL = None


def _key() -> Column:
    """doc_id, or for rows without one a negative number made of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseOR(F.lit(-(2**63))))


def _plain(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text under their names and other columns under numbered ones, so that none clashes with a stage's own."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, as _plain gives them, but for the keys in gone (one column, key)."""
    gone = sized(materialize(gone.select("key").distinct(), "gone"), IDS)
    return docs.withColumn("key", _key()).join(gone, "key", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    rows = _plain(docs)
    scored = toxicity_scores(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), tuple(rows.columns))
    return scored.where("predicted = 0").select(*rows.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line resembles; those of which nothing but blanks is left by that go."""
    rows = _plain(docs)
    out = dedup_lines(rows)
    changed = F.size("removed_lines") > 0
    kept = out.where(~changed | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    chars = F.length("text").cast("long")
    return kept.select(*(F.when(changed, chars).otherwise(F.col(c)).alias(name) if name == "n_chars" else F.col(c).alias(name) for name, c in zip(docs.columns, rows.columns, strict=True)))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; exact repeats of a row leave one."""
    rows = _plain(docs)
    members = materialize(ngram_components(rows.select(_key().alias("doc_id"), "text")), "components")
    kept = _without(rows, members.where("doc_id <> component_id").select(F.col("doc_id").alias("key")))
    again = sized(materialize(members.groupBy(F.col("doc_id").alias("key")).count().where("count > 1").select("key"), "again"), IDS)
    keyed = kept.withColumn("key", _key())
    once = keyed.join(again, "key", "left_semi").dropDuplicates(["key", "text"])
    return keyed.join(again, "key", "left_anti").unionByName(once).select(*rows.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = _plain(docs)
    found = contaminated(rows.select(_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, found.select(F.col("doc_id").alias("key"))).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences."""
    return pack_documents(docs, word_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
