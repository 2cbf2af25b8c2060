"""Written tables that cut lineage, in the shared folder that outlives any executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local master may do without: all its threads see one disk."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tracelake-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Writes a frame and reads it back, so that no earlier step is ever run again; then deletes the files of `spent`, earlier frames of this function."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    PATHS[out] = path
    release(*spent)
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the files of frames that `cut` wrote and that nothing will read any more."""
    for frame in frames:
        if (path := PATHS.pop(frame, None)) is not None:
            at = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
