"""Sessions: settings that the operators rely on, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

import casefile

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors (once for each application), as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(casefile.__file__))
        at = os.path.join(tempfile.mkdtemp(prefix="casefile-"), "casefile-package.zip")
        with zipfile.ZipFile(at, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(at)
        _shipped.add(app)
    return spark


def local_session(cores: int | str = "*", name: str = "casefile", memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A small table's rows dealt out to all cores, for work that is long for each byte: a file with one row group is one task,
    however many cores there are. Tables of over ``most`` bytes have row groups enough and stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is this
    machine (a test) a folder of this machine is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_casefile_dir", None) or tempfile.mkdtemp(prefix="casefile-")
        spark._casefile_dir = at
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/casefile-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application's operators wrote, once their results are used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
