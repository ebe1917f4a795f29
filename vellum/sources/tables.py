"""Tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table, or some of its columns."""
    df = spark.read.parquet(path)
    return dealt(df.select(*columns) if columns else df)


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table that has less than one split for each core, dealt out to all of them; a larger table as it is.

    A row group is read by one task, so a small file would keep all that is computed
    from its rows on one core.  What is shuffled is bounded by the cores' splits.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(2 * cores) if size < cores * split else df
