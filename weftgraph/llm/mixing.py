"""Mixing of sources to target weights by Sainte-Laguë apportionment."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, as_bytes, free, lean, prepared, widened
from weftgraph.session import broadcast_if_small

WEIGHTS = (1.0, 2.0, 3.0)
#: A source gives its size so many times at most.
MOST_REPEATS = 3
#: Blocks of equal size that the mix is made of, if they are no larger than a shard divided by SHARD_BLOCKS; else there are more.
BLOCKS, SHARD_BLOCKS = 1 << 20, 64
#: Words of one shard, and rows, about; shards that are apportioned together.
SHARD_WORDS, SHARD_ROWS, GROUP_SHARDS = 1 << 20, 1 << 18, 1 << 12
SEED = 20240229
#: Sources at most: their totals are apportioned in the driver.
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = MOST_REPEATS) -> list[float]:
    """Words of each source: shares of the total by weight, none above `most` times its size, the excess dealt out again by weight."""
    left, fixed, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not above:
            for i in open_:
                fixed[i] = left * weights[i] / total
            break
        for i in above:
            fixed[i] = float(most * sizes[i])
        left = max(0.0, left - sum(fixed[i] for i in above))
        open_ = [i for i in open_ if i not in set(above)]
    return fixed


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1), ties to the earlier; who has `most` seats gets no more, the next quotient does.

    What is certain is given at once. If all have their most, seats are left over.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    most = [seats] * len(votes) if most is None else most
    # Who has one seat fewer than its share, rounded down, still has one of the highest quotients.
    given = [min(m, max(0, math.floor(v * seats / total) - 1)) for v, m in zip(votes, most)]
    queue = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, given)) if v > 0 and k < most[i]]
    heapq.heapify(queue)
    left = seats - sum(given)
    while left and queue:
        _, i = heapq.heappop(queue)
        given[i] += 1
        left -= 1
        if given[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * given[i] + 1), i))
    return given


def dealt(sizes: list[int], seats: int, block: int, most: int) -> list[int]:
    """Blocks of each of several parts of a source; none gets more than `most` times its size needs."""
    return sainte_lague([float(s) for s in sizes], seats, [-(-most * s // block) for s in sizes])


def counted(docs: DataFrame, id_column: str, text_column: str, size: str, key: str) -> DataFrame:
    """docs with the number of words (runs of anything but the six white-space characters of ASCII; none in a null text), and a hash of id and text."""
    names = docs.columns
    at, of = names.index(id_column), names.index(text_column)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, ids = as_bytes(batch.column(of)), batch.column(at).to_pylist()
            keys = [xxhash.xxh3_64_intdigest(raw, zlib.crc32(str(i).encode())) >> 1 for i, raw in zip(ids, raws)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(raw.split()) for raw in raws], pa.int64()), pa.array(keys, pa.int64())], [*names, size, key])

    return docs.mapInArrow(run, widened(docs.schema, f"`{size}` long, `{key}` long"))


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0,
    most: int = MOST_REPEATS, blocks: int = BLOCKS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, group_shards: int = GROUP_SHARDS, seed: int = SEED, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target and taken, the words that the mix takes of each document, repeats counted; and `row` with the carried columns.

    Sources in code-point order, null last, have the weights in turn. Their
    targets become whole blocks by Sainte-Laguë; a source's blocks go in the same
    way to groups of its shards, and a group's to its shards. A shard is one
    seeded order of documents, about shard_words words or shard_rows rows; a block
    is always small against it. What a shard is to give more than once it gives of
    every document; what is left, from the start of that order, so that one
    document of a shard may be taken in part. No document exceeds `most` times its
    size. Sources without words have target and taken 0, as have documents without
    (null, empty and blank texts). Rows with null or repeated ids count each, and
    are dealt to shards by their text as well; rows that repeat id and text stay
    together. Other columns are carried only if asked for, and may have any name.
    The same rows give the same mix. An empty table gives an empty table.
    """
    spark = prepared(docs.sparkSession)
    scratch = Scratch(spark, "mixing")

    def rows_of(frame: DataFrame, carry: tuple[str, ...]) -> DataFrame:
        src = F.col(source_column).cast("string")
        size, key = free(frame, "size"), free(frame, "key")
        found = counted(frame, id_column, text_column, size, key)
        columns = [F.col(id_column).alias("id"), src.isNull().alias("no_src"), F.coalesce(src, F.lit("")).alias("src"), F.col(size).alias("size"), F.col(key).alias("key")]
        return found.select(*columns, *([F.struct(*carry).alias("row")] if carry else []))

    plain = dict.fromkeys((id_column, text_column, source_column))
    sized = scratch.stored(rows_of(docs.select(*plain), ()))
    of = ["no_src", "src"]
    totals = sized.groupBy(*of).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    if totals.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = sorted(tuple(r) for r in totals.collect())
    sizes = [size for _, _, size, _ in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    block = max(1, min(int(sum(wanted)) // blocks, shard_words // SHARD_BLOCKS))
    quotas = sainte_lague(wanted, round(sum(wanted) / block))
    plan = [(no, src, size, target, quota, max(1, -(-size // shard_words), -(-n // shard_rows))) for (no, src, size, n), target, quota in zip(found, wanted, quotas)]
    sources = broadcast_if_small(spark.createDataFrame(plan, "no_src boolean, src string, source_size long, target double, quota long, shards long"), 10_000)
    shard = F.pmod(F.xxhash64("key", F.lit(seed)), F.col("shards"))

    def to_groups(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("grp")
        return part.assign(quota=dealt(part["grp_size"].tolist(), int(part["quota"].iloc[0]), block, most))[["no_src", "src", "grp", "quota"]]

    def to_shards(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        blocks_of = dealt(part["shard_size"].tolist(), int(part["quota"].iloc[0]), block, most)
        return part.assign(shard_quota=[min(most * s, g * block) for s, g in zip(part["shard_size"], blocks_of)])[["no_src", "src", "shard", "shard_size", "shard_quota"]]

    shards = sized.join(sources, of).withColumn("shard", shard).groupBy(*of, "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shards = scratch.stored(shards.withColumn("grp", F.expr(f"shard div {group_shards}L")))
    groups = shards.groupBy(*of, "grp", "quota").agg(F.sum("shard_size").alias("grp_size"))
    groups = groups.groupBy(*of).applyInPandas(to_groups, "no_src boolean, src string, grp long, quota long")
    shards = shards.drop("quota").join(groups, [*of, "grp"]).groupBy(*of, "grp").applyInPandas(to_shards, "no_src boolean, src string, shard long, shard_size long, shard_quota long")
    shards = broadcast_if_small(scratch.stored(shards), 100_000)
    # What is carried goes through the shards' one shuffle, rather than being joined again.
    rows = rows_of(docs, carry) if carry else sized
    order = Window.partitionBy(*of, "shard").orderBy(F.xxhash64("key", F.lit(seed + 1)), "id", "size", *(["row"] if carry else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.join(sources, of).withColumn("shard", shard).join(shards, [*of, "shard"]).withColumn("before", F.sum("size").over(order) - F.col("size"))
    times = F.expr("if(shard_size > 0, shard_quota div shard_size, 0L)")
    rest = F.col("shard_quota") - times * F.col("shard_size")
    taken = times * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return parts.select("id", F.when(~F.col("no_src"), F.col("src")).alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if carry else []))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: object) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time a document is taken whole, and one with its first words where it is taken in part."""
    names, schema = docs.columns, docs.schema
    chosen = mix(docs, id_column, text_column, carry=tuple(names), **options).where("taken > 0").select(*(F.col("row")[c].alias(c) for c in names), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    at, n = names.index(text_column), len(names)
    word = re.compile(r"[^\x20\x09-\x0D]+")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, (text, size, taken) in enumerate(zip(*(batch.column(k).to_pylist() for k in (at, n, n + 1)))):
                whole, part = divmod(taken, size)
                rows += [i] * (whole + (part > 0))
                texts += [text] * whole
                if part:
                    end = next(m.end() for k, m in enumerate(word.finditer(text), 1) if k == part)
                    texts.append(text[:end])
            taken_rows = batch.take(pa.array(rows, pa.int32()))
            columns = [pa.array(texts, pa.string()) if k == at else taken_rows.column(k) for k in range(n)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return chosen.mapInArrow(run, schema)
