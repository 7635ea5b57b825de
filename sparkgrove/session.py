"""Session helpers: where shared intermediate tables live and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests, benches and small local work."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkgrove")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, for sessions that were not started with it."""
    context = spark.sparkContext
    if getattr(context, "_sparkgrove_shipped", False):
        return
    package = Path(__file__).parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='sparkgrove-')}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._sparkgrove_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    On one machine (a local master, as in tests) a temporary folder stands in where the setting is absent, one per application; on a cluster
    its absence is an error, as executors couldn't read what lies on the driver's machine.
    """
    place = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if place:
        return place.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"{_KEY} is not set: it must name a folder that all executors share")
    if not getattr(context, "_sparkgrove_folder", None):
        context._sparkgrove_folder = tempfile.mkdtemp(prefix="sparkgrove-")
        atexit.register(shutil.rmtree, context._sparkgrove_folder, True)
    return context._sparkgrove_folder


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives the loss of executors, computes ``df`` once, and
    keeps column pruning for the readers.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
