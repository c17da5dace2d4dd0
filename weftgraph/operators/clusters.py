"""Clusters of names: terms, k-means, communities, aligned and agreed partitions."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.session import spread, stored


def terms(names: DataFrame, column: str) -> DataFrame:
    """names with _terms: words and word pairs of split identifiers, without stop words."""
    steps = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\w\w+", gaps=False), StopWordsRemover(inputCol="_words", outputCol="_kept"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"), SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
    ]
    found = names.withColumn("_text", S.split_identifier(F.col(column)))
    for step in steps:
        found = step.transform(found)
    return found.drop("_text", "_words", "_kept", "_pairs")


def tfidf(found: DataFrame) -> DataFrame:
    """Rows of terms() with features: unit TF-IDF vectors."""
    steps = [CountVectorizer(inputCol="_terms", outputCol="_counts"), IDF(inputCol="_counts", outputCol="_raw"), Normalizer(inputCol="_raw", outputCol="features")]
    return Pipeline(stages=steps).fit(found).transform(found)


def cluster_names(names: DataFrame, column: str, most: int = 50, seed: int = 42) -> DataFrame:
    """names with label: k-means with the number of clusters of best silhouette, the fewest of equals; one cluster if no name has a term."""
    found = stored(terms(names, column), "terms")
    if found.where(F.size("_terms") > 0).isEmpty():
        return names.withColumn("label", F.lit(0))
    vectors = stored(tfidf(found).select(*names.columns, "features"), "tfidf")
    n = vectors.count()
    best, chosen = -2.0, None
    for k in range(2, min(most, n - 1) + 1):
        labelled = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(vectors).transform(vectors)
        if labelled.select("label").distinct().count() < 2:
            continue
        score = ClusteringEvaluator(predictionCol="label", featuresCol="features").evaluate(labelled)
        if score > best:
            best, chosen = score, labelled
    return (vectors.withColumn("label", F.lit(0)) if chosen is None else chosen).drop("features")


def sampled_names(rows: DataFrame, group: str, name: str, order: str, n: int = 50) -> DataFrame:
    """(group, names): the first n names of each, joined by "; "."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_n", name)))
    return first.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x[name]), "; ").alias("names"))


def crosstab(rows: DataFrame, by: str, of: str) -> DataFrame:
    """(by, of, n): how often two partitions' labels meet."""
    return rows.groupBy(by, of).agg(F.count("*").alias("n"))


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row of a square matrix with the least total cost, by shortest augmenting paths."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0], column = row, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[column]:
            used[column] = True
            here = match[column]
            slack = np.where(used[1:], np.inf, cost[here - 1] - u[here] - v[1:])
            better = slack < least[1:]
            least[1:][better], way[1:][better] = slack[better], column
            step = np.where(used[1:], np.inf, least[1:])
            following = int(np.argmin(step)) + 1
            delta = step[following - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            column = following
        while column:
            match[column], column = match[way[column]], way[column]
    out = [0] * n
    for column in range(1, n + 1):
        out[match[column] - 1] = column - 1
    return out


def aligned(rows: DataFrame, fixed: str, moving: str) -> DataFrame:
    """rows with `moving` renamed to the labels of `fixed` it meets most; the table of label pairs (not of rows) is solved in the driver."""
    met = crosstab(rows, fixed, moving).collect()
    left, right = sorted({r[fixed] for r in met}), sorted({r[moving] for r in met})
    n = max(len(left), len(right))
    table = np.zeros((n, n))
    for r in met:
        table[right.index(r[moving]), left.index(r[fixed])] = r["n"]
    to = assignment(-table)
    named = [(x, left[to[i]] if to[i] < len(left) else max(left) + 1 + to[i] - len(left)) for i, x in enumerate(right)]
    names = rows.sparkSession.createDataFrame(named, f"{moving} bigint, _to bigint")
    return rows.join(F.broadcast(names), moving, "left").withColumn(moving, F.col("_to")).drop("_to")


def agreement(rows: DataFrame, labels: list[str], least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(classes, links): rows with equal labels are a class (its labels as JSON, its size); links are pairs of classes that share that part of their labels or more.

    n is how many pairs of rows a link stands for; a class is linked with itself
    if it has two rows. Pairs of rows are never made: there are as many as the
    square of a class's size.
    """
    classes = rows.groupBy(*labels).agg(F.count("*").alias("size")).withColumn("class", F.to_json(F.struct(*labels), {"ignoreNullFields": "false"}))
    each = F.array(*(F.struct(F.lit(i).alias("l"), F.col(x).cast("string").alias("v")) for i, x in enumerate(labels)))
    long = classes.select("class", "size", F.explode(each).alias("s")).select("class", "size", "s.l", "s.v").where("v is not null")
    shared = long.select(F.col("class").alias("a"), F.col("size").alias("na"), "l", "v").join(long.select(F.col("class").alias("b"), F.col("size").alias("nb"), "l", "v"), ["l", "v"]).where("a <= b")
    links = shared.groupBy("a", "b", "na", "nb").agg((F.count("*") / len(labels)).alias("weight")).where(F.col("weight") >= least)
    n = F.when(F.col("a") == F.col("b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    return classes, links.select("a", "b", "weight", n.alias("n")).where("n > 0")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label): each node takes its neighbours' most common label, the smallest of equals, a fixed number of times or until nothing changes.

    At first each neighbour has a label of its own, so the first round takes the
    smallest. A node's neighbours meet in one task: there are at most as many as nodes.
    """
    ends = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    pairs = spread(ends, edges.count(), "a", "b").distinct()
    both = stored(pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ("ab", "ba")))).alias("e")).select("e.node", "e.other"), "graph")
    n = both.count()
    nodes = spread(both, n, "node").groupBy("node")
    if rounds < 1:
        return nodes.agg(F.first("node").alias("label"))
    labels = stored(nodes.agg(F.min("other").alias("label")), "labels")
    for _ in range(rounds - 1):
        heard = spread(both, n, "other").join(labels.withColumnRenamed("node", "other"), "other").select("node", "label")
        votes = spread(heard, n, "node").groupBy("node", "label").count()
        new = stored(votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label")), "labels")
        if new.join(labels.withColumnRenamed("label", "_old"), "node").where("label <> _old").isEmpty():
            return new
        labels = new
    return labels


def average_linkage(similarity: np.ndarray, k: int) -> list[int]:
    """Labels of k groups by repeatedly joining the two groups of largest mean similarity; for small partitions' co-association."""
    groups = [[i] for i in range(len(similarity))]
    mean = similarity.astype(float).copy()
    np.fill_diagonal(mean, -np.inf)
    alive = list(range(len(groups)))
    while len(alive) > max(1, k):
        part = mean[np.ix_(alive, alive)]
        a, b = (alive[x] for x in np.unravel_index(np.argmax(part), part.shape))
        a, b = min(a, b), max(a, b)
        wa, wb = len(groups[a]), len(groups[b])
        mean[a] = mean[:, a] = (mean[a] * wa + mean[b] * wb) / (wa + wb)
        mean[a, a] = -np.inf
        groups[a] += groups[b]
        alive.remove(b)
    labels = [0] * len(similarity)
    for label, g in enumerate(sorted(alive, key=lambda g: min(groups[g]))):
        for i in groups[g]:
            labels[i] = label
    return labels
