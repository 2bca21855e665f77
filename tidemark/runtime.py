"""What every operator needs from the session: table paths, the shared folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, as one Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Where the setting is absent and the master is local (tests, a notebook), a temporary folder is made once per
    application; on a cluster the setting is required, since a machine-local folder would not outlive an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = getattr(shared_folder, "_made", {})
    app = spark.sparkContext.applicationId
    if app not in made:
        made[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        shared_folder._made = made
    return made[app]


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget its lineage; survives the loss of any executor.

    Spark removes the files once no plan refers to them, also where the session was not started with that setting.
    """
    sc = df.sparkSession.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/tidemark-{what}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path made by `scratch`, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def local_part(path: str) -> str | None:
    """The plain path where `path` lies on a mounted file system, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith(os.sep) else None


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores, for CPU-heavy row-wise work on few, small files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
