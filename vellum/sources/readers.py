"""Files to rows: text, Markdown, LaTeX, DOCX, PDF, term lists and directory trees.

A file that can't be read gives a row with an error instead of a failed job.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import subprocess
import sys
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T

SCHEMA = "path string, text string, suffix string, source_kind string, warnings array<string>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BAD_BYTES = "The file is not valid UTF-8; undecodable bytes were replaced."
EMPTY_PDF = "The PDF has no extractable text; no optical character recognition is done."


def decode(raw: bytes, strict: bool = False) -> tuple[str, list[str]]:
    """UTF-8 without its byte order mark; bad bytes are an error if strict, else replaced, with a warning, and the mark then stays."""
    try:
        text, warnings = raw.decode("utf-8-sig"), []
    except UnicodeDecodeError:
        if strict:
            raise
        text, warnings = raw.decode("utf-8", "replace"), [BAD_BYTES]
    return re.sub(r"\r\n?", "\n", text), warnings


def docx_text(raw: bytes) -> str:
    """Paragraphs of the body in order, with tabs and line breaks, parted by blank lines."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    found = ("".join(marks.get(x.tag, (x.text or "") if x.tag == f"{_W}t" else "") for x in p.iter()).strip() for p in root.iter(f"{_W}p"))
    return "\n\n".join(p for p in found if p)


def pdf_text(raw: bytes) -> tuple[str, list[str]]:
    """By way of the pdftotext program, where it is installed."""
    tool = shutil.which("pdftotext")
    if not tool:
        raise RuntimeError("pdftotext is not installed")
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(raw)
        f.flush()
        text = subprocess.run([tool, "-layout", f.name, "-"], check=True, capture_output=True).stdout.decode("utf-8", "replace")
    return text, [] if text.strip() else [EMPTY_PDF]


def _read(path: str, raw: bytes, strict: bool = False) -> tuple:
    suffix = os.path.splitext(path)[1].lower() or ".txt"
    try:
        if suffix == ".docx":
            return path, docx_text(raw), suffix, "docx", [], None
        if suffix == ".pdf":
            text, warnings = pdf_text(raw)
            return path, text, suffix, "pdf", warnings, None
        text, warnings = decode(raw, strict)
        return path, text, suffix, "text", warnings, None
    except Exception as e:  # one bad file is a row, not the end of the job
        return path, None, suffix, suffix[1:], [], f"{type(e).__name__}: {e}"


def read_input(spark: SparkSession, raw: bytes | None = None, strict: bool = False) -> DataFrame:
    """What read_sources gives, of the driver's standard input or of bytes read from it, under the path -."""
    raw = sys.stdin.buffer.read() if raw is None else raw
    return spark.createDataFrame([_read("-", raw, strict)], SCHEMA)


def read_sources(spark: SparkSession, *paths: str, strict: bool = False) -> DataFrame:
    """One row per file: path, text, suffix, source_kind, warnings, error; ~ is the driver's home, and strict makes bytes that aren't UTF-8 an error."""
    paths = [os.path.expanduser(p) for p in paths]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_read(p, bytes(c), strict) for p, c in zip(batch["path"], batch["content"])], columns=["path", "text", "suffix", "source_kind", "warnings", "error"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, SCHEMA)


def kind_label(suffix: Column) -> Column:
    return F.when(suffix.isin(".md", ".markdown"), "markdown").when(suffix == ".tex", "latex").otherwise("text")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """pos, term: lines normalised and trimmed, blank ones dropped, exact repeats kept once, in order."""
    lines = _lines(spark, path).select("pos", T.nfkc(F.trim(T.sub(F.col("line"), r"(?U)^\s+|\s+$", ""))).alias("term"))
    return lines.where("term <> ''").groupBy("term").agg(F.min("pos").alias("pos")).select("pos", "term").orderBy("pos")


def read_plain_terms(spark: SparkSession, path: str) -> DataFrame:
    """pos, term: trimmed lines that aren't blank or comments; repeats stay."""
    lines = _lines(spark, path).select("pos", T.sub(F.col("line"), r"(?U)^\s+|\s+$", "").alias("term"))
    return lines.where("term <> '' and not startswith(term, '#')").orderBy("pos")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = read_sources(spark, path).select(F.split("text", "\n", -1).alias("l"))
    return text.select(F.posexplode("l").alias("pos", "line"))


def read_tree(spark: SparkSession, path: str, pruned: tuple[str, ...] = ()) -> DataFrame:
    """path, length, text (null where the bytes aren't UTF-8) of every file below a folder, but for what stands below folders of the pruned names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    for name in pruned:
        files = files.where(~F.contains("path", F.lit(f"/{name}/")))
    return files.select("path", "length", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def link_issues(files: DataFrame, root: str) -> DataFrame:
    """path, code, message for Markdown links of files(path, text) that are absolute, leave the root or lead nowhere; fragments and remote URLs are skipped."""
    own = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rows = files.select(own.alias("path"), F.col("text"))
    inventory = rows.select(F.col("path").alias("target"))
    linked = rows.where(F.col("path").rlike(r"(?i)\.(md|markdown)$")).select("path", F.explode(F.concat(T.find_all(F.col("text"), r"\]\(\s*<?([^)<>\s]+)>?[^)]*\)", 1), T.find_all(F.col("text"), r"(?dm)^\[[^\]]+\]:\s*<?([^\s<>]+)>?", 1))).alias("link"))
    linked = linked.where(~F.col("link").rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//|#)")).withColumn("bare", F.regexp_replace("link", r"[#?].*$", "")).where("bare <> ''")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    parts = F.split(F.concat_ws("/", folder, F.col("bare")), "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p))))
    linked = linked.withColumn("target", F.concat(F.lit("/"), F.array_join(walked, "/")))
    top = root.rstrip("/")
    outside = F.col("target") != top
    absolute = linked.where(F.startswith("bare", F.lit("/"))).select("path", F.lit("absolute_link").alias("code"), F.col("link").alias("message"))
    relative = linked.where(~F.startswith("bare", F.lit("/")))
    escaping = relative.where(outside & ~F.startswith("target", F.lit(f"{top}/"))).select("path", F.lit("escaping_link"), "link")
    inside = relative.where(F.startswith("target", F.lit(f"{top}/")))
    folders = inventory.select(F.regexp_replace("target", r"/[^/]*$", "").alias("target")).distinct()
    missing = inside.join(inventory.union(folders).distinct(), "target", "left_anti").select("path", F.lit("missing_link"), "link")
    return absolute.union(escaping).union(missing).distinct().orderBy("path", "code", "message")
