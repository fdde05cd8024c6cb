"""Session helpers: a local session for tests, and lineage cuts in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "gridloom", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A ``local[cpus]`` session with adaptive execution, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def joins_by_size(spark: SparkSession) -> None:
    """Broadcast only tables whose size adaptive execution has measured.

    The planner guesses from compressed files, and not what an explode makes of them, so that it gives whole
    meshes to the driver to broadcast.
    """
    if spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def shuffles_end(spark: SparkSession) -> None:
    """Remove the files of an action's shuffles when it is over, not when the driver's memory is next cleared.

    A query of many steps otherwise keeps nearly all that it ever shuffled on disk.  A table that is run once more
    makes its shuffles again.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting takes a folder of its own; on a cluster it raises, as a
    machine-local folder would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-gridloom-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, so that readers take single columns; and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


class Round:
    """The table that a loop carries from round to round, written as Parquet.

    A checkpoint keeps the size that the planner guessed for it, and guesses for joins of joins multiply; a
    written table has its real size.  The table of the round before is removed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        df, path = stored(df)
        if self.path:
            remove(self.spark, self.path)
        self.path = path
        return df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, whatever file system its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows_per_task: int = 200_000) -> tuple[DataFrame, int]:
    """``cut``, with no more partitions than the rows need; and the number of rows."""
    df = cut(df)
    n = df.count()
    return df.coalesce(n // rows_per_task + 1), n


def spread(df: DataFrame, *keys: str, rows_per_task: int = 250_000) -> DataFrame:
    """``df`` by ``keys`` over as many tasks as its rows need, so that a task's groups do not grow with the table.

    Groups by these keys, or by more, need no other shuffle.  A table for which the session's number of shuffle
    partitions is enough stays as it is.
    """
    parts = df.count() // rows_per_task + 1
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


BROADCAST_IDS = 200_000


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``: a broadcast of few ids, a shuffled join with many."""
    ids = cut(ids.select(key).distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")
