"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session of one machine (master local) gets a temporary folder where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="webstrata-"))
    return _local[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the plan behind them.
    The tables stay until the folder of the application is removed or ``discard`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webstrata-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._webstrata_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows over all cores, for work that is heavy row by row.

    Only a scan of fewer splits than there are cores is dealt out, once; a large table's splits stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    spark, path = df.sparkSession, df._webstrata_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def lines_or_whole(spark: SparkSession, path: str) -> DataFrame:
    """Items of text files (value): lines, or the whole text of a file in which no line is a JSON object.

    Files of lines are split and read line by line; whole files are read only if there are some.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    is_object = F.trim("value").startswith("{") & F.coalesce(F.size(F.json_object_keys(F.trim("value"))) > 0, F.lit(False))
    files = lines.groupBy("file").agg(F.max(is_object).alias("by_line"))
    whole = files.filter("NOT by_line").select("file")
    if whole.isEmpty():
        return lines.select("value")
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).join(whole, "file", "left_semi")
    return lines.join(whole, "file", "left_anti").select("value").unionByName(texts.select("value"))
