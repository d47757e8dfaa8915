"""Session construction and small helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "leafstack", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE, UTC, Arrow).

    Sizing (shuffle partitions, split bytes, memory) is left to the cluster unless given in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` of a dataset directory (one Parquet file or folder per table)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and all tasks run on this machine (tests) is a temporary folder set
    instead; on a cluster the missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "leafstack-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's engine ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes intermediate folders that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def materialize(df: DataFrame, label: str, written: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    It cuts the lineage the way ``checkpoint()`` does, but columnar and prunable, and survives
    the loss of an executor. The path is added to ``written``, for :func:`discard`.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many parts as the cluster has cores, so that a table of few files does not keep the others idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of the session, once, so that they need no installation."""
    context = spark.sparkContext
    if getattr(context, "_leafstack_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="leafstack-")
    archive = os.path.join(folder, "leafstack.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for base, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.join("leafstack", os.path.relpath(full, root)))
    context.addPyFile(archive)
    context._leafstack_shipped = True
