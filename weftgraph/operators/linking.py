"""Linking calls to definitions, filtering and re-numbering graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.ids import dense_ids
from weftgraph.session import spread, stored


def link_calls(calls: DataFrame, functions: DataFrame, name: str = "combinedName", caller: str = "func_id", callee: str = "fnc_id") -> DataFrame:
    """(source, target): one row for each call and definition of its name; calls outside functions don't link."""
    known = functions.select(F.col(name).alias("_name"), F.col(callee).alias("target"))
    return calls.where(F.col(caller).isNotNull()).join(known, F.col(name) == F.col("_name")).select(F.col(caller).alias("source"), "target")


def external_nodes(calls: DataFrame, functions: DataFrame, name: str = "combinedName", callee: str = "fnc_id") -> DataFrame:
    """(id, name) of called names without a definition; ids go on after the largest known, by name."""
    unknown = calls.select(F.col(name).alias("name")).where("name is not null").join(functions.select(F.col(name).alias("name")), "name", "left_anti").distinct()
    last = functions.agg(F.max(callee)).first()[0]
    return dense_ids(unknown, ["name"], "id", 0 if last is None else last + 1).select("id", "name")


def link_with_externals(calls: DataFrame, functions: DataFrame, name: str = "combinedName", caller: str = "func_id", callee: str = "fnc_id") -> tuple[DataFrame, DataFrame]:
    """(edges, external nodes): calls without a definition link to an external node of their name."""
    outside = external_nodes(calls, functions, name, callee)
    every = functions.select(F.col(name).alias("_name"), F.col(callee).alias("target")).unionByName(outside.select(F.col("name").alias("_name"), F.col("id").alias("target")))
    edges = calls.where(F.col(caller).isNotNull()).join(every, F.col(name) == F.col("_name")).select(F.col(caller).alias("source"), "target")
    return edges, outside


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()


def existing_edges(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select(F.col(key).alias("_id"))
    return edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(ids, F.col("target") == F.col("_id"), "left_semi")


def filtered_graph(nodes: DataFrame, edges: DataFrame, key: str = "id", keep: DataFrame | None = None, remove_isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes re-numbered from 0 in the order of their old ids, and the edges between them.

    keep: ids to which the nodes are restricted; remove_isolated: nodes without an
    edge go. Parallel edges stay.
    """
    if keep is not None:
        nodes = nodes.join(keep.select(F.col(key)).distinct(), key, "left_semi")
    if remove_isolated:
        nodes = nodes.join(endpoints(existing_edges(edges, nodes, key)).withColumnRenamed("id", key), key, "left_semi")
    numbered = dense_ids(nodes, [key], "ID")
    return numbered, remapped(edges, numbered.select(F.col(key).alias("_old"), "ID"))


def remapped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends by the table (_old, ID); those without an end there go."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    first = edges.join(ids, edges.source == ids._old).select(F.col("ID").alias("_s"), "target", *rest)
    return first.join(ids.withColumnRenamed("_old", "_other"), F.col("target") == F.col("_other")).select(F.col("_s").alias("source"), F.col("ID").alias("target"), *rest)


def subgraph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (func_id, source, target) with both nodes in their function, once each."""
    n, m = nodes.count(), edges.count()
    edges = edges.select("func_id", "source", "target")
    for end in ("source", "target"):
        ids = spread(nodes.select("func_id", F.col("node_id").alias(end)), n, "func_id", end).distinct()
        edges = spread(edges, max(n, m), "func_id", end).join(ids, ["func_id", end], "left_semi")
    return edges.select("func_id", "source", "target").distinct()


def filtered_subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of functions' subgraphs: edges with both nodes in their function, once each, re-numbered over all functions."""
    fine = stored(subgraph_edges(nodes, edges), "subgraphs")
    m, n = fine.count(), nodes.count()
    used = spread(fine.select("func_id", F.explode(F.array("source", "target")).alias("node_id")), 2 * m, "func_id", "node_id").distinct()
    numbered = dense_ids(spread(nodes, max(n, 2 * m), "func_id", "node_id").join(used, ["func_id", "node_id"], "left_semi"), ["func_id", "node_id"], "ID")
    out = fine
    for end, name in (("source", "s"), ("target", "t")):
        out = spread(out, max(n, m), "func_id", end).join(numbered.select("func_id", F.col("node_id").alias(end), F.col("ID").alias(name)), ["func_id", end])
    return numbered, out.select(F.col("s").alias("source"), F.col("t").alias("target"), "func_id")


def leaf_chain(nodes: DataFrame, group: str, order: str) -> DataFrame:
    """(group, source, target): each leaf and the next one."""
    following = F.lead(order).over(Window.partitionBy(group).orderBy(order))
    return nodes.select(group, F.col(order).alias("source"), following.alias("target")).where("target is not null")


def scoped(uses: DataFrame, scopes: DataFrame, keys: list[str], use: list[str], at: str, start: str, end: str, declared: str) -> DataFrame:
    """Each use (told apart by its own columns) with the scope around it that was declared last: an equi-join on keys with a range, then one row for each use."""
    joined = uses.join(scopes, keys).where(F.col(at).between(F.col(start), F.col(end)))
    return keep_first(joined, use, [F.col(declared).desc()])


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def changed(base: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between base and head, or that only one has."""
    joined = base.select(key, F.col(value).alias("_b")).join(head.select(key, F.col(value).alias("_h")), key, "full_outer")
    return joined.where(~F.col("_b").eqNullSafe(F.col("_h"))).select(key)


def looked_up(df: DataFrame, known: DataFrame, keys: list[str], where: Column) -> DataFrame:
    """df with known's other columns, null without a match; known has a key once. Rows that `where` doesn't hold for find nothing and aren't joined, so that they don't meet in the task of one key."""
    asked = F.coalesce(where, F.lit(False))
    return df.where(asked).join(known, keys, "left").unionByName(df.where(~asked), allowMissingColumns=True)


def with_default(df: DataFrame, names: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    """df with a looked-up name, or a default where there is none."""
    return df.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), default))


def contained_in_other(df: DataFrame, name: str, gram: int = 4) -> DataFrame:
    """Names that are part of a different name.

    Candidates share the name's first characters, found anywhere in the other:
    an equi-join on those before the containment is tested, not all pairs. Names
    shorter than that share all of them, cut at their own length.
    """
    names = df.select(F.col(name).alias("a")).distinct().where("a <> ''")
    sizes = F.array(*(F.lit(i) for i in range(1, gram + 1)))
    inner = names.withColumn("g", F.left("a", F.lit(gram)))
    grams = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("a") - n + 1, F.lit(1))), lambda i: F.substring("a", i, n))))
    outer = names.select(F.col("a").alias("b"), F.explode(F.array_distinct(grams)).alias("g"))
    return inner.join(outer, "g").where("a <> b and contains(b, a)").select(F.col("a").alias(name)).distinct()
