"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyforge")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TALLYFORGE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application, so that they need not be started beside it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="tallyforge-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "tallyforge.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for where, _, names in sorted(os.walk(package)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(where, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)


def clear_work(spark: SparkSession) -> None:
    """Delete what this application has written to the checkpoint folder; its tables cannot be read any more."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}")
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def checkpoint_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    This ends the lineage (a lost executor re-reads files instead of recomputing
    the whole chain) and gives the next join real size statistics.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for all cores before costly row work.

    Only an input of fewer partitions than cores (one small file, say) is
    shuffled; a large input already has more and passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
