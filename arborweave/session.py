"""Session helpers: shipping this package to executors and cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Spark's setting for the bytes of rows that go to a Python worker at once (64 MB by default), and the value that ``small_batches`` gives it.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _own_folder(prefix: str) -> str:
    """A folder of this driver process, removed when it ends."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The archive goes through ``addPyFile``; Spark copies it to every executor, late ones included.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(_own_folder("arborweave-"), "arborweave.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Send rows with texts to Python workers ``BATCH_BYTES`` at a time in this session, unless it names a size itself.

    A batch is held in the executor's JVM and in the worker, for each task; its size changes no results.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or, in local mode alone, one of our own where it is unset."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + _own_folder("arborweave-checkpoint-"))
        current = context.getCheckpointDir()
    return str(current).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: lineage ends at files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, for rows that hold texts.

    Unlike a checkpoint the files are compressed and columnar. They stay until the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
