"""Session helpers: reading tables and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: kernels in Python import it, from wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gridloom-package-")) / "gridloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    _SENT.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only where it is unset, one of our own.

    A private temporary folder is chosen for local masters only, and removed at the end: on a cluster the
    executors would not share it, so a missing setting is an error there. Files of checkpoints that nothing refers to
    any more are removed by Spark where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    send_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` over all cores: rows of a scan with fewer partitions than cores are dealt out, others stay where they are.

    For work that costs far more than the rows' way over the network (parsing, encoding). A large table has more
    partitions than cores, so there it adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
