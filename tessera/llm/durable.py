"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a reader of it.

    Losing an executor then costs at most the stage at hand, and what follows is planned from
    a file whose size is known.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_at = path
    return found


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that no variable refers to any more; those of a caller end only when it returns."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``settle`` once nothing will read them again."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def apart(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text): the columns other than the text as a struct, so that their names cannot clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("row"), F.col(text_col).alias("text"))


def together(found: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns that ``apart`` took apart, in their order."""
    return found.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns))
