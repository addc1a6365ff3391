"""The session's shared folder, for results that several executors read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only a local session that names none gets one of its own; a cluster's
    executors could not read the driver's folders, so there its lack is an error."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if not named.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
        named = sc._jsc.sc().getCheckpointDir()
    return named.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of one long run of rounds, as Parquet under the shared folder; all are deleted at its end.

    A checkpointed table keeps the estimate of its size, and joins multiply estimates: over many rounds these become
    numbers of millions of digits. A table that is read back has its size on disk."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.kept = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.kept += 1
        path = f"{self.folder}/{self.kept}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
