"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode where the session names no folder, as in tests.
FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, FALLBACK is set in local mode; on a cluster, whose
    executors don't share a local folder, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = FALLBACK
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in replicated files, which go with the frame."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columns that are not asked for are not read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation, which remove() deletes once no result reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def _path(self, name: str) -> str:
        self.paths.append(f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = self._path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``df`` as a table of buckets: it is shuffled once, and not again by joins and groups on ``key``. As many
        buckets as the session has shuffle partitions."""
        n, called = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
        self.tables.append(called)
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", self._path(name)).saveAsTable(called)
        return self.spark.table(called)

    def remove(self) -> None:
        # The adaptive plan may leave stages behind that a result turned out not to need; they still read.
        time.sleep(0.2)
        for _ in range(20):
            if not self.spark.sparkContext.statusTracker().getActiveStageIds():
                break
            time.sleep(0.1)
        for name in self.tables:
            self.spark.sql(f"drop table if exists `{name}`")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(conf).delete(path, True)
        self.paths, self.tables = [], []
