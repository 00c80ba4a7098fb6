"""Reading the parquet tables of a data directory, and the shared folder of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of `sf_dir`, a parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which the cluster names in spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder, once; elsewhere an unset folder is an error, as another machine could not read a local one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="lodeline-"))
    return spark.conf.get("spark.checkpoint.dir")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let checkpoint() write to the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def parallelism(spark: SparkSession, times: int = 2) -> int:
    """Number of partitions for CPU-heavy stages: a few waves on the cores there are."""
    return max(8, times * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
