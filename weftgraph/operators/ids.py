"""Dense numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import parts_of, stored


def dense_ids(df: DataFrame, by: list[str | Column], name: str = "ID", start: int = 0) -> DataFrame:
    """df with ids start, start + 1, ... in the order of `by`, which must tell all rows apart.

    Rows are dealt out by range, sorted and numbered within each part; only the
    parts' sizes meet in one place. df is written first, so that it runs once (a
    range is found by a sample of its own), and so are the dealt rows, so that all
    uses see the same ranges.
    """
    keys = {c if isinstance(c, str) else f"_k{i}": c for i, c in enumerate(by)}
    held = stored(df.select("*", *(k.alias(n) for n, k in keys.items() if not isinstance(k, str))), "rows")
    n = parts_of(df.sparkSession, held.count())
    ranged = held.repartitionByRange(*keys) if n is None else held.repartitionByRange(n, *keys)
    dealt = stored(ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ids")  # the part's number in the bits above 33, the row's in those below
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_n", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each part
    return dealt.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_n") + start).cast("bigint").alias(name), *(c for c in df.columns if c != name))
