"""What the engine takes from the running session: task counts and scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def task_count(spark: SparkSession) -> int:
    """Partitions for steps that compute a lot from few bytes.

    Adaptive execution merges shuffle partitions by their size in bytes, which
    would leave such a step with a handful of tasks; a partition count given to
    ``repartition`` is kept.
    """
    chosen = spark.conf.getAll.get("spark.sql.shuffle.partitions", "0")  # only where somebody set it
    return max(1, int(3.5 * spark.sparkContext.defaultParallelism), int(chosen))


#: Intermediate tables of one driver lie in a folder of their own.
_RUN = f"tidegap-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, with this driver's own folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        # One machine holds the driver and all tasks only in plain local mode.
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegap-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{_RUN}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder of the cluster."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this driver's intermediate tables, once nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later steps do not redo it.

    The copy lies in the shared checkpoint folder: a lost executor costs only the
    tasks it was running. It stays until :func:`clear_scratch` or the cluster removes it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
