"""Reports: nested JSON for tables of results, and Markdown for one report."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: What a report may claim.
RULES = ("What differs is for a person to look at; equal counts don't show that two texts say the same, nor different ones that they don't.",)


def python_round(value: float | None, places: int) -> float | None:
    """Half to even on the exact binary value, as reports show numbers."""
    return None if value is None else round(value, places)


def describe_report(n: int, total: int, squares: int, least: int | None, most: int | None, median_x2: int | None, variation: str) -> dict:
    """A length summary as shown: population deviation, two places, three for cv; nulls where there is nothing."""
    if not n:
        return {"count": 0, "mean": None, "median": None, "stdev": None, "cv": None, "variation_signal": "insufficient_data", "min": None, "max": None}
    mean, spread = total / n, max(0, n * squares - total * total) ** 0.5 / n
    return {"count": n, "mean": round(mean, 2), "median": round(median_x2 / 2, 2), "stdev": round(spread, 2), "cv": round(spread / mean, 3) if mean else None, "variation_signal": variation, "min": least, "max": most}


def lock_reports(differences: DataFrame, status: DataFrame) -> DataFrame:
    """doc_id, report (JSON): a category's counts and its removed and added items, repeated and sorted."""
    repeated = lambda c: F.array_sort(F.flatten(F.collect_list(F.array_repeat("value", F.col(c).cast("int")))))
    by = differences.groupBy("doc_id", "category").agg(F.sum("n_before").alias("before_count"), F.sum("n_after").alias("after_count"), repeated("removed").alias("removed"), repeated("added").alias("added"))
    entry: Column = F.struct("before_count", "after_count", "removed", "added")
    grouped = by.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", entry.alias("found"))))).alias("categories"))
    rows = status.join(grouped, "doc_id", "left")
    summary = F.struct("high_risk_categories", "warning_categories")
    return rows.select("doc_id", F.to_json(F.struct("status", summary.alias("summary"), "categories", F.array(*(F.lit(r) for r in RULES)).alias("interpretation_rules"))).alias("report"))


def pretty(report: Mapping | Row | str) -> str:
    """One report as indented JSON, in its own key order, non-ASCII kept."""
    if isinstance(report, str):
        report = json.loads(report)
    return json.dumps(report.asDict(recursive=True) if isinstance(report, Row) else report, ensure_ascii=False, indent=2)


def escape_cell(value: object) -> str:
    return html.escape(str(value), quote=False).replace("|", "\\|").replace("\n", "<br>").replace("`", "\\`")


def markdown_table(header: list[str], rows: list[tuple]) -> str:
    lines = ["| " + " | ".join(map(escape_cell, header)) + " |", "|" + "---|" * len(header)]
    return "\n".join([*lines, *("| " + " | ".join(map(escape_cell, r)) + " |" for r in rows)]) + "\n"
