"""The stateless measures over a stream of documents, and an incremental sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.functions import text as T
from vellum.operators import style


def measured(stream: DataFrame) -> DataFrame:
    """documents(doc_id, text) as they come -> the counts of each, without state."""
    rows = stream.select("doc_id", T.clean(F.col("text")).alias("t"))
    lang = T.language(F.col("t"))
    return rows.select("doc_id", lang.alias("language"), F.size(T.tokens(F.col("t"))).cast("long").alias("n_tokens"), F.size(T.all_sentences(F.col("t"), style.MIN_TOKENS)).cast("long").alias("n_sentences"), T.units(F.col("t"), lang).alias("units"))


def write_measured(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the measures to Parquet, each document once even after a restart."""
    return measured(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
