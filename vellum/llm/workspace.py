"""Where intermediate tables go: the shared folder named by ``spark.checkpoint.dir``.

Executors may be lost at any time, so lineage is cut with files in that folder
only.  Where the session names none, a temporary folder is set in local mode
(tests); on a cluster that is an error, as other hosts couldn't read it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side with two or three narrow columns is broadcast after its rows were counted.
BROADCAST_ROWS = 200_000


#: Rows and bytes of an Arrow batch: texts have no bound of their own, so the default of 10,000 rows may be any size.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, which bounds what a task holds in the JVM and in Python."""
    prefix = "spark.sql.execution.arrow.max"
    rows = int(spark.conf.get(f"{prefix}RecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(f"{prefix}RecordsPerBatch", BATCH_ROWS)
        spark.conf.set(f"{prefix}BytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder for this application's tables, under spark.checkpoint.dir."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="vellum-")
        sc.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/vellum-{sc.applicationId}"
    if not getattr(sc, "_vellum_registered", False):
        sc._vellum_registered = True
        # shuffle files go when their query ends; what is read again is in a table by then
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)
        atexit.register(_delete, sc, path)
    return path


def _delete(sc, path: str) -> None:
    try:
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session has ended: nothing to do it with
        return


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    jvm, path = table.sparkSession.sparkContext._jvm, table._vellum_path
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialized table of narrow rows, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= rows else df
