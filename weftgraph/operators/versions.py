"""Histories of functions: versions where the body changes, their chain, and the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.ids import dense_ids
from weftgraph.operators.linking import keep_first


def versions(history: DataFrame, symbol: list[str], order: list[str], body: str, start: int = 0) -> DataFrame:
    """Rows whose body differs from the symbol's one before, with ID: symbols by their first appearance, each in its order.

    A skipped row has the body of the one kept before it, so comparing with the
    row before is comparing with the version before. A reverted body is a new
    version.
    """
    window = Window.partitionBy(*symbol).orderBy(*order)
    before = F.lag(F.struct(F.col(body).alias("b"))).over(window)
    kept = history.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before.b").eqNullSafe(F.col(body))).drop("_before")
    seen = kept.withColumn("_seen", F.min(F.struct(*order)).over(Window.partitionBy(*symbol)))
    return dense_ids(seen, ["_seen", *symbol, *order], "ID", start).drop("_seen")


def version_chain(kept: DataFrame, symbol: list[str]) -> DataFrame:
    """(source, target): each version and the next of its symbol."""
    following = F.lag("ID").over(Window.partitionBy(*symbol).orderBy("ID"))
    return kept.select(following.alias("source"), F.col("ID").alias("target")).where("source is not null")


def latest_versions(kept: DataFrame, symbol: list[str]) -> DataFrame:
    """The last version of each symbol."""
    return keep_first(kept, symbol, [F.col("ID").desc()])
