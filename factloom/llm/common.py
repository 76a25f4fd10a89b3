"""What the operators share: the shared folder, written tables, words, labels of connected rows."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import discard, fresh_path, freed  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_if_any(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The named table of an input folder, or None where the folder has none."""
    try:
        return table(spark, sf_dir, name)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written Parquet table in the shared folder, reread.

    It cuts the lineage: a lost executor costs no more than the tasks that read the table.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, records: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as rows may be long, and let local Python workers import this package.

    A smaller bound that the user has set is kept; a bound that another operator has set isn't.
    """
    key, own, user = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.factloom.batchRows", "spark.factloom.userBatchRows"
    now = spark.conf.get(key, "10000")
    if now != spark.conf.get(own, None):
        spark.conf.set(user, now)
    most = int(spark.conf.get(user))
    now = str(records if most <= 0 else min(most, records))
    spark.conf.set(key, now)
    spark.conf.set(own, now)
    # workers get these variables; on a cluster the package comes with the job, and the path is simply not there
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each end of edges (a, b: long) with the smallest id that it reaches: rows (id, label).

    Alternates two star steps: every node hands its neighbours the smallest of them, first to the larger
    ones, then to the smaller ones. No neighbourhood is ever collected: a minimum per node (summed on the
    map side) is joined back to the edges. The rounds needed grow with the logarithm of the diameter.
    """

    def sides(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def settled(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()[:2]

    # a is the larger end, b the smaller one
    e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = settled(e)
    for _ in range(max_rounds):
        both = sides(e)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least2, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select("x.a", F.col("x.m").alias("b"))
        e = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        after = settled(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"labels did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
