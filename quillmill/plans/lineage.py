"""Cutting lineage through the folder that all executors share.

The cluster names that folder in ``spark.checkpoint.dir``. Only where the setting is absent and the master is local, as in
tests, a folder under the system's temporary directory is used; on a cluster without the setting there is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets the context's checkpoint directory if it has none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not configured and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="quillmill-"))
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow table; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a checkpointed table that nothing reads any more, so that long iterations do not fill the folder."""
    place = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if place.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as compressed parquet into the shared folder and read back.

    Used instead of a checkpoint where rows hold text: a checkpoint is not compressed. The table is deleted when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
