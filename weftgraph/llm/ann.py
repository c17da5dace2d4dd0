"""Approximate nearest neighbours: inverted lists of product-quantised residuals, each list ranked exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, prepared

#: Vectors that centroids and codebooks are fitted on at most: the first by a hash of the id.
SAMPLE_ROWS = 20_000
#: Coarse lists: this many at most, and one for so many vectors.
MOST_LISTS, LIST_ROWS = 256, 40
#: Parts a residual is quantised in, and codewords of each.
PARTS, WORDS = 16, 256
#: Share of the lists a query visits, and how many at least.
PROBE_SHARE, LEAST_PROBES = 0.6, 24
#: Rows of a list, and queries, that meet in one task at most (about), and bytes that the vectors of either have.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_BYTES = 1 << 16, 1 << 15, 1 << 25
#: Pairs of a query and a row that are looked at together.
PAIRS = 1 << 20
#: Room for rounding in single precision, as a share of the lengths that take part.
SLACK = 1e-5
SEED = 5


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centre, in blocks."""
    norms = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(norms - x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, steps: int = 8, seed: int = SEED) -> np.ndarray:
    """Centres of at most k groups; a group that loses all its rows keeps its centre."""
    rng = np.random.RandomState(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(steps):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class Index:
    """Coarse centroids and the codebooks of residuals; small, the same size whatever is indexed."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, words: int = WORDS):
        self.centroids = kmeans(sample, lists)
        residuals = sample - self.centroids[_nearest(sample, self.centroids)]
        self.cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).round().astype(int)
        self.books = [kmeans(residuals[:, a:b], words, 6) for a, b in zip(self.cuts, self.cuts[1:])]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each vector."""
        own = _nearest(x, self.centroids)
        residuals = x - self.centroids[own]
        return own, np.stack([_nearest(residuals[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of each vector (in double precision) from what its list and codes stand for."""
        back = self.centroids[own].astype(float)
        for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            back[:, a:b] += book[codes[:, i]]
        return np.sqrt(((x - back) ** 2).sum(axis=1))

    def far(self, queries: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Distance from each query to what each row of codes stands for in a list."""
        residual = queries.astype(np.float32) - self.centroids[own]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            table = ((residual[:, None, a:b] - book[None]) ** 2).sum(axis=2)
            out += table[:, codes[:, i]]
        return np.sqrt(out)

    def nearest(self, k: int, asked: np.ndarray, queries: np.ndarray, own: int, ids: np.ndarray, codes: np.ndarray, errors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's number, row's number, distance) of the k rows of a list nearest to each query, other than itself; ids ascend.

        A row is measured unless its approximate distance, less its quantisation
        error, is more than the exact distance of the k-th of those that seem nearest.
        """
        far = self.far(queries, own, codes)
        lower = np.where(np.isfinite(far), far, 0) - errors
        other = ids != asked[:, None]
        bound = np.full(len(queries), np.inf)
        if len(ids) > k:
            seem = np.argpartition(np.where(other, far, np.inf), k - 1, axis=1)[:, :k]
            at = np.repeat(np.arange(len(queries)), k)
            own_row = ~other[at, seem.ravel()]
            bound = np.where(own_row, np.inf, distances(queries, x, at, seem.ravel())).reshape(-1, k).max(axis=1)
        room = SLACK * (np.sqrt((queries**2).sum(axis=1)) + float(np.linalg.norm(self.centroids[own])) + bound)
        at, row = np.nonzero(other & ~(lower > (bound + room)[:, None]))
        exact = distances(queries, x, at, row)
        order = np.lexsort((row, exact, at))
        at, row, exact = at[order], row[order], exact[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[first], row[first], exact[first]


def distances(queries: np.ndarray, x: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pair in double precision, summed in the order of the components."""
    out = np.zeros(len(at))
    for lo in range(0, len(at), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        for square in ((queries[at[part]] - x[row[part]]) ** 2).T:
            out[part] += square
    return np.sqrt(out)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): vectors that take part, one for each id (the smallest array of those that repeat it).

    Left out are null ids and vectors, empty and zero vectors, and vectors with a
    null or non-finite component.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & v.isNotNull()).where(F.coalesce(fine, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 100, k: int = 10, probe_share: float = PROBE_SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row whose id is divisible by `every`, among all other rows.

    Score is the Euclidean distance of the original vectors in double precision;
    ties go to the smaller id. Of an id that repeats, the smallest vector counts.
    usable() says which vectors take part; of those, only the ones with the most
    common number of components (the smaller of equals). All rows are indexed;
    only centroids and codebooks are fitted on a bounded sample. A query visits
    the nearest lists, a share of all, and further ones until they hold k
    others; of a list it visits, it gets the k nearest exactly, however many
    rows have the same codes. Fewer candidates than k give as many rows; an
    empty table none.
    """
    spark = prepared(vectors.sparkSession)
    scratch = Scratch(spark, "ann")
    rows = scratch.stored(usable(vectors, id_column, vector_column))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes["d"])
    total = sizes["count"]
    picked = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample_rows)
    sample = np.array([r["v"] for r in picked.select(F.col("v").cast("array<float>")).collect()], np.float32)
    index = Index(sample, min(MOST_LISTS, max(1, total // LIST_ROWS)))

    kept = "<f4" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "<f8"  # no value changes

    def packed(x: np.ndarray) -> pa.Array:
        return pa.array([v.tobytes() for v in x.astype(kept)], pa.binary())

    def unpacked(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), kept).reshape(len(column), -1).astype(float)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                own, codes = index.coded(x.astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(index.errors(x, own, codes)), packed(x)], ["id", "list", "codes", "error", "x"]
                )

    coded = scratch.stored(rows.select("id", "v").mapInArrow(assigned, "id long, list int, codes binary, error double, x binary"))
    held = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}
    counts = np.array([held.get(i, 0) for i in range(len(index.centroids))])
    probes = min(len(counts), max(LEAST_PROBES, math.ceil(probe_share * len(counts))))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, at = [], [], []
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, 1))
            for i, query in enumerate(x.astype(np.float32)):
                order = np.argsort(((index.centroids - query) ** 2).sum(axis=1), kind="stable")
                enough = int(np.searchsorted(np.cumsum(counts[order]), min(k + 1, total))) + 1
                chosen = order[: max(probes, enough)]
                lists += chosen[counts[chosen] > 0].tolist()
                at += [i] * int((counts[chosen] > 0).sum())
            taken = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), pa.array(lists, pa.int32()), packed(x).take(taken)], ["query_id", "list", "q"])

    asked = scratch.stored(rows.where(F.col("id") % every == 0).select("id", "v").mapInArrow(visits, "query_id long, list int, q binary"))
    asks = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    fit = max(1, BLOCK_BYTES // (8 * sizes["d"]))
    most_rows, most_queries = min(BLOCK_ROWS, fit), min(BLOCK_QUERIES, fit)
    blocks = spark.createDataFrame([(i, -(-n // most_rows), -(-asks.get(i, 0) // most_queries)) for i, n in held.items()], "list int, row_blocks int, query_blocks int")
    blocks = F.broadcast(blocks)  # a row for each list, of which there are MOST_LISTS at most
    left = asked.join(blocks, "list").select("list", F.pmod(F.xxhash64("query_id"), "query_blocks").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb"), "query_id", "q")
    right = coded.join(blocks, "list").where("query_blocks > 0").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks").cast("long") - 1)).alias("qb"), F.pmod(F.xxhash64("id"), F.col("row_blocks")).cast("int").alias("rb"), "id", "codes", "error", "x")

    def near(asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asks) and len(have):
            have = have.sort_values("id")
            ids, errors, x = have["id"].to_numpy(), have["error"].to_numpy(), unpacked(have["x"])
            codes = np.frombuffer(b"".join(have["codes"]), np.uint8).reshape(len(have), -1)
            own, step = int(have["list"].iloc[0]), max(1, min(256, PAIRS // len(have)))
            for lo in range(0, len(asks), step):
                some = asks.iloc[lo : lo + step]
                query = some["query_id"].to_numpy()
                at, row, score = index.nearest(k, query, unpacked(some["q"]), own, ids, codes, errors, x)
                found.append(pd.DataFrame({"query_id": query[at], "vec_id": ids[row], "score": score}))
        return pd.concat(found) if found else pd.DataFrame([], columns=["query_id", "vec_id", "score"])

    keys = ["list", "qb", "rb"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(near, "query_id long, vec_id long, score double")
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
