"""Session helpers shared by every operator: table reading, checkpoint folder, sizing."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    On a cluster the setting comes with the session and is used as it is. Only where it is
    unset (tests, local mode) a local folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(path)
        return path
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "codeloom-checkpoints")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in all Python workers, once per context.

    Workers find the functions of a plan by their module. Where the driver alone has the package on
    its path, they would not; Spark hands the archive to every executor, new ones included.
    """
    sc = spark.sparkContext
    if getattr(sc, "_codeloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="codeloom-"), "codeloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, folders, names in os.walk(home):
            folders[:] = sorted(d for d in folders if d != "__pycache__")
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._codeloom_shipped = True
