"""Table-generating operators: sections, paragraphs and sentences as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import text as T


def _any_in(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("|".join(rf"\Q{p}\E" for p in parts))


def section_key(title: Column) -> Column:
    """How a section is matched between versions: its number, abstract, references, or its letters."""
    title = T.squeeze(title)
    number = F.regexp_extract(title, r"^\s*(\p{Nd}+)(?:[.、)]|\s)", 1)
    low = F.lower(title)
    return (
        F.when(number != "", F.concat(F.lit("n:"), number.cast("decimal(38,0)").cast("string")))
        .when(low.isin(*P.ABSTRACT), "abstract")
        .when(_any_in(low, P.REFERENCES), "references")
        .otherwise(F.concat(F.lit("t:"), T.sub(low, r"[^0-9a-z\x{3400}-\x{9fff}]+", "")))
    )


def section_array(text: Column) -> Column:
    """array<struct<level, title, body>>: headings on the raw text; what stands before the first goes; without headings one section."""
    chunks = F.filter(F.split(text, r"(?dm)(?=^#{1,6}\s+\S)", -1), lambda c: c.rlike(r"\A#{1,6}\s+\S"))
    found = F.transform(
        chunks,
        lambda c: F.struct(
            F.length(F.regexp_extract(c, r"\A(#{1,6})\s", 1)).alias("level"),
            F.regexp_extract(c, r"(?Ud)\A#{1,6}\s+([^\n]*?)\s*(?:\n|\z)", 1).alias("title"),
            T.sub(T.sub(c, r"(?Ud)\A#{1,6}\s+[^\n]*", ""), r"(?U)\A\s+|\s+\z", "").alias("body"),
        ),
    )
    whole = F.array(F.struct(F.lit(1).alias("level"), F.lit("Document").alias("title"), text.alias("body")))
    return F.when(F.size(found) > 0, found).otherwise(whole)


def keyed_array(text: Column) -> Column:
    """section_array with the keys: array<struct<key, level, title, body>>."""
    text = F.coalesce(text, F.lit(""))
    whole = lambda s, n: (n == 1) & (s["title"] == "Document") & (s["level"] == 1)
    keyed = lambda n: lambda s: F.struct(F.when(whole(s, n), "document").otherwise(section_key(s["title"])).alias("key"), s["level"].alias("level"), s["title"].alias("title"), s["body"].alias("body"))
    return T.let(section_array(text), lambda every: F.transform(every, keyed(F.size(every))))


def sections(docs: DataFrame, column: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, pos, n_sections, level, title, key, body."""
    rows = docs.select("doc_id", *carry, section_array(F.col(column)).alias("s")).select("doc_id", *carry, F.size("s").alias("n_sections"), F.posexplode("s").alias("pos", "s"))
    out = rows.select("doc_id", *carry, "pos", "n_sections", "s.level", "s.title", "s.body")
    key = F.when((F.col("n_sections") == 1) & (F.col("title") == "Document") & (F.col("level") == 1), "document").otherwise(section_key(F.col("title")))
    return out.withColumn("key", key)


def body_sections(rows: DataFrame) -> DataFrame:
    """The gate's body sections: not abstract or references, nor a title above others."""
    return rows.where(~F.col("key").isin("abstract", "references") & ~((F.col("level") == 1) & (F.col("n_sections") > 1)))


def texture_sections(docs: DataFrame, column: str, suffix: str = ".md") -> DataFrame:
    """The texture audit's body sections with the whole text's language: the numbered ones if there are any, else as the gate's by title."""
    array = section_array(F.col(column))
    numbered = lambda s: F.trim(s["title"]).rlike(r"(?U)^\s*\d+(?:[.、)]|\s)")
    low = lambda s: F.lower(s["title"])
    plain = lambda all_: F.filter(all_, lambda s: ~low(s).isin(*P.ABSTRACT) & ~_any_in(low(s), P.REFERENCES) & ~((s["level"] == 1) & (F.size(all_) > 1)))
    rows = docs.select("doc_id", T.language(T.clean(F.col(column), suffix)).alias("language"), array.alias("all"))
    rows = rows.select("doc_id", "language", F.when(F.exists("all", numbered), F.filter("all", numbered)).otherwise(plain(F.col("all"))).alias("s"))
    return rows.select("doc_id", "language", F.size("s").alias("n_sections"), F.posexplode_outer("s").alias("pos", "s")).select("doc_id", "language", "n_sections", "pos", "s.title", "s.body")


def sentence_rows(docs: DataFrame, column: str, suffix: str = ".txt", min_tokens: int = 4) -> DataFrame:
    """doc_id, pos, sentence of each cleaned text."""
    cleaned = docs.select("doc_id", T.clean(F.col(column), suffix).alias("t"))
    return cleaned.select("doc_id", F.posexplode(T.all_sentences(F.col("t"), min_tokens)).alias("pos", "sentence"))
