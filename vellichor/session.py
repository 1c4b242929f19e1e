"""Session helpers: reading tables and staging intermediate results in shared storage."""

from __future__ import annotations

import gc
import sys
import tempfile
import time
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Workers may start in another folder: functions of this package travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt over all of them: work that is heavy per row would run in a task or two. Larger tables are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where nothing is set and Spark is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellichor-"))
            jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get()
    return found.rstrip("/")


def staged(df: DataFrame, compression: str = "zstd", bucket: tuple[int, str] | None = None) -> DataFrame:
    """Write df to the shared folder and return a reader of it: cuts lineage and survives lost executors.

    With bucket=(n, column) the table is hash-bucketed, so later joins on that column move only the other side.
    """
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    writer = df.write.option("compression", compression)
    if bucket is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n, column = bucket
    writer.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(name)
    return spark.table(name)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/stage_" in f}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle(spark: SparkSession) -> None:
    """Let the driver forget finished shuffles, so that executors delete their files before the next ones are written.

    Twice, with a pause: the end of the last query is still being reported when its call returns.
    """
    for _ in range(2):
        time.sleep(0.7)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
