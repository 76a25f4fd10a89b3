"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set on the context; where neither is set, a temporary folder in local mode and an error on a cluster."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df cut from its lineage: a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join of shuffles: a table that is small on disk may be large in memory, and broadcasts of many rounds add up in the driver."""
    return df.hint("merge")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cut from its lineage, and of a size that Spark knows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and the shuffle files of finished writes.

    What was made of the tables has to be written itself by now: then no lost executor needs them.
    """
    context = tables[0].sparkSession.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    for df in tables:
        folders = {x.rsplit("/", 1)[0] for x in df.inputFiles()}
        for at in folders:
            if re.search(r"/[\w-]+-[0-9a-f]{32}$", at):
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(conf).delete(path, True)
    freed(tables[0].sparkSession)


def freed(spark: SparkSession) -> None:
    """Let the driver find shuffles of finished writes, so that Spark deletes their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
