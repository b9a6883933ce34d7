"""Where a fit keeps the tables it reads many times.

A learner scans its compacted training table once per tree level.  That table is
written to the shared folder named by ``spark.checkpoint.dir`` and read back, so a
lost executor costs one re-read and not a re-run of everything before it.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str | None:
    """The folder of ``spark.checkpoint.dir``, if the session names one."""
    return spark.conf.get("spark.checkpoint.dir", None)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input of few files; one of as many files as cores is left alone.

    Asks the plan for its files only, so nothing is run to find out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or len(df.inputFiles()) >= cores:
        return df
    # Dealt out by a running number: even, and without the sort of a round-robin exchange.
    return df.repartition(cores, F.monotonically_increasing_id())


class Scratch:
    """Tables written during one fit; they are dropped when the ``with`` block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[str] = []
        self._persisted: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        folder = shared_folder(self.spark)
        if folder is None:
            # No shared folder: the cache spills to disk and rebuilds lost blocks itself.
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(df)
            return df
        path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._paths.append(path)
        return self.spark.read.parquet(path)

    def release(self) -> None:
        for df in self._persisted:
            df.unpersist()
        jvm = self.spark._jvm
        for path in self._paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self._persisted, self._paths = [], []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        self.release()
