"""Reading inputs and cutting lineage for the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one process, as in local tests.
LOCAL_SHARED = "/tmp/lattica-shared"
#: Bytes of an Arrow batch between executors and Python workers, where the session doesn't say; rows of whole texts would
#: otherwise come by the ten thousand. Bytes of a row group of the tables written on the way.
BATCH, ROW_GROUP = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m"), 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or LOCAL_SHARED


def small_batches(df: DataFrame) -> DataFrame:
    """df itself; from now on its session bounds the bytes of Arrow batches, unless it has a bound of its own."""
    if df.sparkSession.conf.get(BATCH[0], None) is None:
        df.sparkSession.conf.set(*BATCH)
    return df


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and lost executors cost no more than a reread.

    The driver's JVM is asked for a collection afterwards, so that shuffle files of the plan just written can go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what settled() wrote for these frames: only once all that is read from them has been settled in turn."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices_for(docs: DataFrame, column: str, bytes_each: int) -> int:
    """How many slices a keyed exchange needs so that each holds about bytes_each of the column's text.

    One scan of one column; the answer follows the data, and is never below spark.sql.shuffle.partitions.
    """
    total = docs.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // bytes_each))
