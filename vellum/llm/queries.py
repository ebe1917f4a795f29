"""The queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import chat, secrets, topk, warc
from vellum.llm.decontaminate import contaminated
from vellum.llm.line_dedup import dedup_lines
from vellum.llm.ngram_join import ngram_components
from vellum.llm.packing import pack_documents
from vellum.llm.passages import repeated_passages
from vellum.llm.toxicity import toxicity_scores
from vellum.sources.tables import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The packing tokenizer's vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, removed_lines (places, comma-joined), text_md5 of what stays."""
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), F.md5("text").alias("text_md5"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embedding_neighbours(_table(spark, sf_dir, "embeddings"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), word_tokenizer())


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(_table(spark, sf_dir, "conversations"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_line_dedup, op2_secret_scan, op3_exact_topk, op4_warc_revisits, op5_decontamination, op6_best_fit_packing, op7_chat_formatting, op8_ngram_jaccard_join, op9_substring_dedup, op10_toxicity)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.secret_digest_sql(),
        "op3_exact_topk": topk.NEIGHBOURS_SQL,
        "op4_warc_revisits": warc.ROUND_TRIP_SQL,
        "op7_chat_formatting": chat.READ_BACK_SQL,
    }
