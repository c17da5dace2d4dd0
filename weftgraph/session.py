"""Session helpers shared by every part of the engine: shipping the package, sharing intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_ROWS = 1_000_000  # rows that a task takes, about
_SHIPPED: set[str] = set()
_SCRATCH: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, wherever the worker was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "weftgraph_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = _SCRATCH.get(context.applicationId)
        if configured is None:
            configured = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
            _SCRATCH[context.applicationId] = configured
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
        pass


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage without depending on any executor: what is written survives
    the loss of the machine that wrote it. Removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def task_number(spark: SparkSession) -> int:
    """How many tasks work is dealt to that takes long for its bytes: as many as the cluster's cores or a shuffle's parts, whichever are more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_of(spark: SparkSession, rows: int) -> int | None:
    """The number of parts of about PART_ROWS rows, not under a shuffle's own; None for so few rows that Spark may choose."""
    return None if rows <= PART_ROWS else max(-(-rows // PART_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, which has that many rows, dealt by keys so that a task's rows, and with them its memory, don't grow with the table.

    Spark sizes parts by their compressed bytes and the cluster's cores, which can
    be many millions of short rows. What is dealt here is not put together again
    or broadcast, and the other side of a join is dealt alike. Few rows stay as they are.
    """
    n = parts_of(df.sparkSession, rows)
    return df if n is None else df.repartition(n, *keys).hint("merge")


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most most_rows rows (counts no further than needed)."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bound, else df as it is (a shuffle join follows)."""
    return F.broadcast(df) if small_enough(df, most_rows) else df
