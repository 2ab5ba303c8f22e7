"""Tables that an operator writes between its steps, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What crosses to Python at once, in rows and bytes. Spark's defaults (10,000 rows, 64 MiB) would be held several times over, by each task of an executor and its worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Set BATCHES for the session, but for what the application or the cluster has set itself."""
    own = spark.sparkContext.getConf()
    for key, value in BATCHES.items():
        if not own.contains(key):
            spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset and all runs in one process, as in tests, a local folder becomes that setting; on a cluster that is an error, since executors don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """A folder of its own for one run of an operator. A lost executor costs only the unfinished step: what is saved has no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back. Its shuffle files go as soon as it is written."""
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN)
            else:
                self.spark.conf.set(_CLEAN, before)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
