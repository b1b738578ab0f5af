"""Session helpers: table loading and durable intermediate results."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a dataset folder through Spark's own reader (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary one; on a cluster executors could not read such a folder, so that is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docweft-"))
    return context.getCheckpointDir()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/docweft-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but stays columnar and compressed; a lost executor costs a re-read, never a
    recomputation of what came before. Files lie in one folder per application, to be deleted with it or by ``release``.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docweft_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that ``durable`` returned, once nothing unwritten reads them any more."""
    for frame in frames:
        path, spark = getattr(frame, "_docweft_path", None), frame.sparkSession
        if path and path.startswith(_own_dir(spark)):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now: they go when the driver collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
