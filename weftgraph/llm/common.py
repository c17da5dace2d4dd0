"""What the training-data operators share: reading tables, Arrow batches, components of links."""

from __future__ import annotations

import atexit
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.session import _remove, shared_folder, ship_package

#: An Arrow batch given to Python ends at whichever comes first, so that long texts make short batches.
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20
#: The C library's number of the setting for what is large, and that size: arrays from it on go back to the system when freed.
_MMAP_THRESHOLD, LARGE_BYTES = -3, 1 << 20
_EDGES_TOGETHER = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on every worker and bounded Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that only Spark needs to understand."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared folder.

    Written tables survive lost executors and cut the lineage. A write's shuffle
    files go when it ends; a table goes by drop(), or when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/weftgraph-{self.name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        atexit.register(_remove, self.spark, path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (path, found)
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Remove the files of tables that stored() returned; nothing may read them afterwards."""
        for df in tables:
            if found := self.paths.pop(id(df), None):
                _remove(self.spark, found[0])


def _libc(name: str, *args: int) -> None:
    call = getattr(ctypes.CDLL(None), name, None)  # of the GNU C library alone
    if call is not None:
        call(*args)


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run(batches, ...) for mapInArrow that gives memory back: large arrays as they are freed, all that is free when the task ends.

    Workers are used again by later tasks, and would hold on to it.
    """

    @functools.wraps(run)
    def whole(*args: object) -> Iterator[pa.RecordBatch]:
        _libc("mallopt", _MMAP_THRESHOLD, LARGE_BYTES)
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            _libc("malloc_trim", 0)

    return whole


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def widened(schema: StructType, ddl: str) -> StructType:
    """The schema with more fields at its end."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def free(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many (but for the last)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.concat_batches(held)
            held, count = [], 0
    if count:
        yield pa.concat_batches(held)


def id_remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % divisor


@lean
def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> as stars: each node that a batch of edges reaches with the smallest of them."""
    for batch in regrouped(batches, _EDGES_TOGETHER):
        nodes, at = np.unique(np.concatenate([batch.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
        a, b = at[: batch.num_rows], at[batch.num_rows :]
        low = np.arange(len(nodes))
        while len(a):
            x, y = low[a], low[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low[low] != low).any():
                low = low[low]
        linked = np.flatnonzero(low != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[low[linked]])], ["a", "b"])


def connected_components(scratch: Scratch, edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node (a long) of an edge; the component is its smallest node.

    Alternating large-star and small-star steps: each replaces a node's
    neighbours by links to the smallest of them, and each task contracts what it
    holds, until only stars are left. A step's work is in proportion to the
    edges; the minimum of a hub's neighbours is pre-aggregated before the
    shuffle, and Spark splits a hub's rows in the join. Each round is written to
    the shared folder. Null ends and loops are ignored; an empty table gives an
    empty table.
    """
    a, b = F.greatest(left, right), F.least(left, right)
    pair = "a long, b long"
    now = scratch.stored(edges.select(a.cast("long").alias("a"), b.cast("long").alias("b")).where("a > b").distinct().mapInArrow(_contracted, pair))
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        then = scratch.stored(small.mapInArrow(_contracted, pair))
        scratch.drop(now)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
