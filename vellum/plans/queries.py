"""The audit queries: single documents over ``documents`` and ``pages``, pairs and sections over the derived manuscripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import gate, guard, lock, segment, style, texture
from vellum.plans.manuscripts import chinese, manuscripts
from vellum.plans.oracles import TERMS
from vellum.sources.tables import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscripts(_documents(spark, sf_dir))


def _before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", F.col("before").alias("text"))


def _long(df: DataFrame) -> DataFrame:
    """Counts and places as longs."""
    return df.select(*(F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() in ("int", "smallint") else F.col(f.name) for f in df.schema))


def _on(source: Callable, operator: Callable, *drop: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _long(operator(source(spark, sf_dir)).drop(*drop))


def _section_digest(pairs: DataFrame) -> DataFrame:
    return segment.sections(pairs, "after").select("doc_id", "pos", "level", "title", "key", F.length("body").alias("body_chars"), F.md5("body").alias("body_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    of = lambda *c: lambda p: lock.lock_category(p, c, TERMS)
    return {
        "doc_tokens": _on(_documents, style.token_table),
        "doc_units_language": _on(_documents, style.units_and_language),
        "doc_sentences": _on(_documents, style.sentence_table),
        "length_variation": _on(_documents, style.describe),
        "lexical_diversity": _on(_documents, style.lexical),
        "punctuation_density": _on(_documents, style.punctuation),
        "punctuation_per_thousand": _on(_documents, style.punctuation_per_thousand),
        "sentence_openings": _on(_documents, style.openings),
        "paragraph_openings": _on(_before, style.paragraph_openings),
        "repeated_trigrams": _on(_documents, style.trigrams),
        "stock_phrases": _on(_before, style.stock_phrases),
        "transition_hedge_booster": _on(_before, style.term_counts),
        "triadic_lists": _on(_before, style.triads),
        "repeated_cjk_phrases": _on(lambda spark, sf_dir: chinese(_documents(spark, sf_dir)), style.cjk_phrases),
        "clean_markdown_pages": lambda spark, sf_dir: _long(style.clean_pages(read_table(spark, f"{sf_dir}/pages.parquet", "page_id", "html"))),
        "lock_numbers": _on(_pairs, of("numbers"), "category"),
        "lock_citations": _on(_pairs, of("citations"), "category"),
        "lock_identifiers": _on(_pairs, of("identifiers"), "category"),
        "lock_protected_spans": _on(_pairs, of("protected_spans"), "category"),
        "lock_stance": _on(_pairs, of(*lock.STANCE)),
        "lock_terms": _on(_pairs, of("terms"), "category"),
        "lock_status": _on(_pairs, lambda p: lock.lock_status(p, TERMS)),
        "guard_numbers": _on(_pairs, lambda p: guard.guard_items(p, "numbers"), "category"),
        "guard_citations": _on(_pairs, lambda p: guard.guard_items(p, "citations"), "category"),
        "guard_templates": _on(_pairs, guard.templates),
        "guard_lengths": _on(_pairs, guard.lengths),
        "guard_overlap": _on(_pairs, guard.overlap),
        "guard_terms": _on(_pairs, lambda p: guard.term_mismatches(p, TERMS)),
        "guard_blockers": _on(_pairs, lambda p: guard.blockers(p, TERMS)),
        "sections": _on(_pairs, _section_digest),
        "section_retention": _on(_pairs, gate.section_retention),
        "heading_changes": _on(_pairs, gate.heading_changes),
        "content_recall": _on(_pairs, gate.content_recall),
        "abstract_conclusion_cosine": _on(_pairs, gate.abstract_conclusion),
        "section_architecture": _on(_pairs, gate.architecture),
        "move_profiles": _on(_pairs, gate.move_profiles),
        "profile_modes": _on(_pairs, gate.profile_modes),
        "editorial_residue": _on(_pairs, gate.residue),
        "source_placeholders": _on(_pairs, gate.placeholders),
        "gate_findings": _on(_pairs, gate.findings),
        "gate_findings_ready": _on(_pairs, lambda p: gate.findings(p, gate.Limits(min_output_units=300, publication_ready=True))),
        "paragraph_geometry": _on(_pairs, lambda p: texture.rollup(p, "after")),
        "corrective_negation": _on(_pairs, lambda p: texture.corrective(p, "after")),
        "section_closures": _on(_pairs, lambda p: texture.closures(p, "after")),
        "meta_voice": _on(_pairs, lambda p: texture.meta_voice(p, "after")),
        "texture_signals": _on(_pairs, lambda p: texture.signals(p, "after")),
        "texture_signals_strict": _on(_pairs, lambda p: texture.signals(p, "after", strict=True)),
    }
